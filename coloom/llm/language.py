"""Language identification with error-correcting output codes.

Every language has a codeword.  One binary classifier per bit, over hashed byte
n-grams, predicts that bit; a text gets the language whose codeword has the
lowest loss against the predicted margins, and is flagged where the next one is
close.  A few wrong bits do not change the result.

``learn`` fits the classifiers on a sample of labelled rows: the ``per_language``
rows of each language with the smallest hashes of id and text, one for each hash, so
the sample is bounded whatever the size of the table and whatever ids are shared.  The weights (bits x ``DIMS``) are what is
broadcast.  ``predict_column`` is a column expression over the text alone.

A text that is null or has no letter is ``und`` with score 0.  A language is learnt
from rows with a label and a letter; without any such row every text is ``und``.
With one language there is nothing to decide, and each text with a letter gets it
with score 1.  Repeated rows are rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coloom.llm.common import raw, table

#: Hashed n-gram features.
DIMS = 1 << 11
#: Bytes of a text that are counted at a time.
CHUNK = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
ASCII_LETTER = re.compile(rb"[A-Za-z]")
UND = "und"


def has_letter(text: bytes) -> bool:
    return bool(ASCII_LETTER.search(text)) or bool(LETTER.search(text.decode("utf-8", "ignore")))


def features(text: bytes) -> np.ndarray:
    """Square roots of the shares of hashed 1- to 3-byte grams, of length 1.

    White space counts as one gap, so single words have their borders.
    """
    data = b" " + b" ".join(text.lower().split()) + b" "
    counts = np.zeros(DIMS)
    for at in range(0, len(data), CHUNK):
        x = np.frombuffer(data[at : at + CHUNK + 2], np.uint8).astype(np.uint32)
        grams = [x, x[:-1] << 8 | x[1:], x[:-2] << 16 | x[1:-1] << 8 | x[2:]]
        for order, g in enumerate(grams):
            mixed = (g + np.uint32(order << 24)) * np.uint32(0x9E3779B1)
            counts += np.bincount(mixed[:CHUNK] >> np.uint32(32 - 11), minlength=DIMS)
    out = np.sqrt(counts)
    return (out / max(np.sqrt((out * out).sum()), 1e-12)).astype(np.float32)


def codewords(n: int, bits: int = 31, seed: int = 7) -> np.ndarray:
    """A codeword (row of -1 and 1) for each of ``n`` languages.

    Up to five languages get the exhaustive code: every way to part them in two.
    More get random codes; of many tries the one with the largest smallest
    distance between two codewords is taken.
    """
    if n < 2:
        return np.ones((n, 0))
    if n <= 5:
        rows = [c for k in range(n - 1) for c in combinations(range(1, n), k)]
        return np.array([[1 if i == 0 or i in c else -1 for c in rows] for i in range(n)], float)
    rng, best, most = np.random.default_rng(seed), None, -1.0
    size = max(bits, int(10 * np.ceil(np.log2(n))))
    for _ in range(200):
        code = rng.choice([-1.0, 1.0], (n, size))
        if (np.abs(code.sum(0)) == n).any():
            continue
        least = (size - (code @ code.T)[~np.eye(n, dtype=bool)].max()) / 2
        if least > most:
            best, most = code, least
    return best


@dataclass
class Coder:
    """Languages, their codewords, and one linear classifier per bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest language, its score, and the lead over the next one, for rows of margins.

        The loss of a codeword is the sum of log(1 + exp(-bit * margin)), the
        classifiers' own loss.  The score is the softmax of the losses.
        """
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None]).sum(2)
        share = np.exp(loss.min(1, keepdims=True) - loss)
        share /= share.sum(1, keepdims=True)
        ranked = np.sort(share, 1)
        lead = ranked[:, -1] - ranked[:, -2] if share.shape[1] > 1 else np.ones(len(share))
        return loss.argmin(1), ranked[:, -1], lead

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, bool]]:
        """(language, score, ambiguous) of each text."""
        out: list[tuple[str, float, bool]] = [(UND, 0.0, True)] * len(texts)
        known = [i for i, t in enumerate(texts) if self.languages and has_letter(t)]
        for at in range(0, len(known), 512):
            some = known[at : at + 512]
            x = np.stack([features(texts[i]) for i in some])
            best, score, lead = self.decide(x @ self.weights.T + self.bias)
            for i, b, s, d in zip(some, best.tolist(), score.tolist(), lead.tolist(), strict=True):
                out[i] = (self.languages[b], s, d < 0.2)
        return out


def fit(x: np.ndarray, labels: list[str], rounds: int = 300, rate: float = 8.0, decay: float = 1e-5) -> Coder:
    """Logistic classifiers for all bits, by accelerated gradient steps; languages weigh the same."""
    languages = sorted(set(labels))
    code = codewords(len(languages))
    at = np.array([languages.index(v) for v in labels], int)
    w, b = np.zeros((code.shape[1], x.shape[1] if x.size else DIMS), np.float32), np.zeros(code.shape[1], np.float32)
    if code.shape[1]:
        target = code[at].astype(np.float32)
        weight = ((1 / np.bincount(at, minlength=len(languages)))[at][:, None] / len(languages)).astype(np.float32)
        step_w, step_b = np.zeros_like(w), np.zeros_like(b)
        for _ in range(rounds):
            margin = np.clip(target * (x @ (w + 0.9 * step_w).T + b + 0.9 * step_b), -30, 30)
            pull = weight * target / (1 + np.exp(margin))
            step_w = 0.9 * step_w + rate * (pull.T @ x - decay * w)
            step_b = 0.9 * step_b + rate * pull.sum(0)
            w, b = w + step_w, b + step_b
    return Coder(languages, code, w, b)


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, per_language: int = 400) -> Coder:
    """Classifiers from at most ``per_language`` rows of each language of ``labelled``."""
    named = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    named = named.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(text_col, id_col, F.lit("sample")).alias("h"))
    # The sample is the same however the rows are dealt.  Hashes first, and texts only of those that are chosen.
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = named.select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= per_language)
    last = {r[0]: r[1] for r in least.groupBy("lang").agg(F.max("h")).collect()}  # one row per language
    if not last:
        return fit(np.zeros((0, DIMS)), [])
    chosen = F.coalesce(*[F.when(F.col("lang") == v, F.col("h") <= h) for v, h in last.items()])

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([features(t).tobytes() if has_letter(t) else None for t in texts.to_pylist()], pa.binary())

    sample = named.where(chosen).dropDuplicates(["lang", "h"]).select("lang", of(raw("text")).alias("x"))
    rows = [(r["lang"], np.frombuffer(r["x"], np.float32)) for r in sample.collect() if r["x"] is not None]
    rows.sort(key=lambda r: (r[0], r[1].tobytes()))
    return fit(np.array([x for _, x in rows], np.float32).reshape(-1, DIMS), [v for v, _ in rows])


def letter_column(text_col: str) -> Column:
    """Whether the text has a letter."""

    @F.arrow_udf("boolean")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([has_letter(t) for t in texts.to_pylist()], pa.bool_())

    return of(raw(text_col))


def predict_column(coder: Coder, text_col: str) -> Column:
    """struct(lang, score, ambiguous) of the text."""

    @F.arrow_udf("struct<lang: string, score: double, ambiguous: boolean>")
    def of(texts: pa.Array) -> pa.Array:
        found = coder.predict(texts.to_pylist())
        return pa.StructArray.from_arrays(
            [
                pa.array([f[0] for f in found], pa.string()),
                pa.array([f[1] for f in found], pa.float64()),
                pa.array([f[2] for f in found], pa.bool_()),
            ],
            ["lang", "score", "ambiguous"],
        )

    return of(raw(text_col))


def remainder(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; an id that is null counts as empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % of


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = remainder("doc_id", 3)
    coder = learn(docs.where(fold != 1), "doc_id", "text", "lang")
    return docs.select("doc_id", (fold == 1).alias("held_out"), predict_column(coder, "text").alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score", "p.ambiguous"
    )
