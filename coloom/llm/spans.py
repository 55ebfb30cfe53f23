"""Spans of pattern matches and the texts around them, in column expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start: int, end: int>>"


def none() -> Column:
    return F.array().cast(SPAN)


def matches(text: Column, pattern: Column | str) -> Column:
    """All leftmost non-overlapping matches, as strings."""
    return F.regexp_extract_all(text, pattern if isinstance(pattern, Column) else F.lit(pattern), F.lit(0))


def spans(text: Column, pattern: Column | str, found: Column, keep: Callable[[Column], Column]) -> Column:
    """Where the matches ``found`` of ``pattern`` stand, of those that ``keep`` lets through.

    The text is the pieces between the matches and the matches in turn, so a
    match starts after the pieces and matches before it.  Offsets are code points.
    """
    pieces = F.split(text, pattern, -1)
    steps = F.arrays_zip(pieces.alias("piece"), found.alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["piece"])
        end = start + F.char_length(x["hit"])
        here = F.array(F.struct(start.alias("start"), end.alias("end")))
        kept = F.when(keep(x["hit"]), F.concat(acc["out"], here)).otherwise(acc["out"])
        return F.struct(end.alias("at"), kept.alias("out"))

    # The piece after the last match has no match.
    walked = F.aggregate(
        F.slice(steps, 1, F.size(found)),
        F.struct(F.lit(0).alias("at"), none().alias("out")),
        step,
        lambda acc: acc["out"],
    )
    return F.when(F.size(found) > 0, walked).otherwise(none())


def text_of(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])


def written(labelled: Column) -> Column:
    """kind:start:end of an array of (kind, start, end), comma-joined."""
    return F.array_join(
        F.transform(labelled, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def labelled(kinds: list[str], found: dict[str, Column]) -> Column:
    """(order, start, end, kind) of all spans, one kind after the other."""

    def named(order: int, kind: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(
            F.lit(order).alias("order"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")
        )

    return F.concat(*[F.transform(found[k], named(i, k)) for i, k in enumerate(kinds)])


def by_start(s: Column) -> Column:
    """Sorted by start, then by the order of kinds."""
    keyed = F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["order"].alias("order"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.array_sort(keyed)


def sql_spans(source: str, kinds: list[tuple[str, str, str]]) -> str:
    """DuckDB: (rid, ord, kind, s, e, hit) of all matches of (kind, pattern, condition on hit) in ``source(rid, text)``."""
    parts = []
    for order, (kind, pattern, condition) in enumerate(kinds):
        quoted = pattern.replace("'", "''")
        parts.append(
            f"""SELECT rid, {order} AS ord, '{kind}' AS kind, s, s + length(hit) AS e, hit FROM (
  SELECT rid, m[i] AS hit,
         coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)
         + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT rid, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT rid, regexp_extract_all(text, '{quoted}') AS m, string_split_regex(text, '{quoted}') AS p FROM {source})))
WHERE {condition}"""
        )
    return "\nUNION ALL\n".join(parts)
