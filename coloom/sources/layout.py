"""Where inputs and results live."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Layout:
    """Folder names under one base folder; the base may be any Hadoop URI."""

    base: str

    def _under(self, folder: str, name: str) -> str:
        return "/".join(p for p in (self.base.rstrip("/"), folder, name) if p)

    def raw_text(self, name: str = "") -> str:
        return self._under("raw_text", name)

    def data(self, name: str = "") -> str:
        return self._under("data", name)

    def result(self, name: str = "") -> str:
        return self._under("results", name)

    def paper(self, name: str = "") -> str:
        return self._under("paper", name)

    def figure(self, name: str = "") -> str:
        return self._under("paper/figures", name)
