"""Hard negatives by exact integer scores from tables of subset sums (Four Russians).

1. Components are scaled and floored to integers and written as bit planes of two's
   complement: for each plane, eight dimensions are one byte.  A candidate is its bytes.
2. For an anchor and a group of eight dimensions, a table holds the sum of the anchor's
   integers over each of the 256 subsets.  A candidate's byte of a plane looks up what its
   set bits add; the planes are added up by shifts, the topmost one negative.  That is the
   exact inner product.  Tables of a few hundred anchors are built side by side, so that a
   byte fetches a row of them.
3. Candidates stream past the tables of a block of anchors.  Two passes: the first keeps
   each anchor's best rows of its own label, the positives; the second keeps, for each
   positive, the best rows of other labels with scores in its band.  A task holds one batch
   of candidates, the tables of some anchors and what these have kept.
4. What the tasks kept is merged by anchor (and positive): at most ``k`` rows from each.

Anchors are a stated query set and go out in rounds of ``ROUND``, which bounds the
broadcast.  Higher scores come first, ties go to the smaller id.

Rows take no part where the id or the label is null, the vector is null or empty, or a
component is null or not finite; nor vectors of another length than most, nor with a scaled
component outside of 27 bits (their products might leave 64 bits).  Of rows with the same id
the smallest (vector, label) counts; ids are long integers.  Equal vectors are rows like any other, however many;
a label may hold all rows.  Zero vectors take part.  An empty table, or one without usable
rows, gives no rows.  Texts are not read.  Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coloom.llm.common import table
from coloom.session import cut

#: Anchors of a round (what is broadcast), anchors whose tables are built together, candidates of a batch.
ROUND, ABREAST, BATCH = 32768, 128, 4096
#: Candidates that one task streams through, at most.
TASK_ROWS = 1 << 16
#: Scaled components have this many bits at most.
MOST_BITS = 27


def planes(x: np.ndarray, bits: int) -> np.ndarray:
    """The bytes (rows, planes, groups) of integers in two's complement of ``bits`` bits."""
    n, dims = x.shape
    groups = -(-dims // 8)
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :dims] = x
    out = np.empty((n, bits, groups), np.uint8)
    for j in range(bits):
        out[:, j] = np.packbits((wide >> j & 1).astype(np.uint8).reshape(n, groups, 8), axis=2, bitorder="little")[:, :, 0]
    return out


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sum of each anchor's integers over each subset of eight dimensions."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    wide = np.zeros((n, groups * 8), np.int64)
    wide[:, :dims] = anchors
    out = np.zeros((groups, 256, n), np.int64)
    for g in range(groups):
        for b in range(8):
            np.add(out[g, : 1 << b], wide[:, 8 * g + b], out=out[g, 1 << b : 2 << b])
    return out


def scores(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(rows, anchors): the inner products of candidates given as planes."""
    n, bits, groups = codes.shape
    total = np.zeros((n, tables.shape[2]), np.int64)
    for j in reversed(range(bits)):
        # From the topmost plane down: double what there is, add this plane.
        total <<= 1
        for g in range(groups):
            found = tables[g].take(codes[:, j, g], axis=0)
            if j == bits - 1:
                total -= found
            else:
                total += found
    return total


class Best:
    """The k best (score, id) seen, by higher score, then smaller id."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int | None:
        """A score that is needed to get in, once there are k."""
        return int(self.score[-1]) if len(self.score) == self.k else None

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(score) > 4 * self.k:
            least = np.partition(score, len(score) - self.k)[len(score) - self.k]
            score, ids = score[score >= least], ids[score >= least]
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


def _usable(rows: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """(id, label, x): valid rows, one per id."""
    limit = float(1 << MOST_BITS - 1)
    named = rows.select(
        F.col(id_col).cast("long").alias("id"),
        label.alias("label"),
        F.transform(F.col(vector_col).cast("array<double>"), lambda v: F.lit(float(scale)) * v).alias("v"),
    )
    # No number (it counts as greatest) and the infinities fall outside as well.
    finite = F.forall("v", lambda v: (v >= -limit) & (v < limit))
    whole = named.where(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)))
    return whole.groupBy("id").agg(F.min(F.struct(F.transform("v", lambda v: F.floor(v).cast("int")).alias("x"), "label")).alias("row")).select("id", "row.*")


def _coded(valid: DataFrame, dims: int, bits: int, parts: int) -> DataFrame:
    """(id, label, code) in ``parts`` partitions."""
    kind = valid.schema["label"].dataType.simpleString()

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            flat = planes(x, bits).reshape(len(x), -1)
            packed = pa.array([r.tobytes() for r in flat], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), packed], ["id", "label", "code"])

    return valid.repartition(parts, "id").mapInArrow(code, f"id long, label {kind}, code binary")


def _stream(coded: DataFrame, sent, shape: tuple[int, int], keep, schema: str) -> DataFrame:
    """What ``keep`` retains of the scores of all candidates, for the anchors that were sent.

    ``keep`` is made once in a task from the anchors; it takes (first anchor, scores, ids,
    labels) and gives its rows at the end.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, more = sent.value
        kept = keep(anchors, more)
        x = anchors["x"]
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(-1, *shape)
                ids = part.column("id").to_numpy(zero_copy_only=False)
                labels = part.column("label").to_numpy(zero_copy_only=False)
                for first in range(0, len(x), ABREAST):
                    some = slice(first, first + ABREAST)
                    rows = kept.rows(some, labels)
                    if rows is None:
                        kept.add(first, scores(codes, subset_sums(x[some])), ids, labels)
                    elif len(rows):
                        kept.add(first, scores(codes[rows], subset_sums(x[some])), ids[rows], labels[rows])
        yield from kept.out()

    return coded.mapInArrow(run, schema)


class _Positives:
    """The best other rows of each anchor's own label; anchors are sorted by label."""

    def __init__(self, anchors: dict, k: int) -> None:
        self.anchors = anchors
        self.best = [Best(k) for _ in anchors["id"]]

    def rows(self, some: slice, labels: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.isin(labels, self.anchors["label"][some]))

    def add(self, first: int, found: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        for a in range(found.shape[1]):
            best, column = self.best[first + a], found[:, a]
            fits = (labels == self.anchors["label"][first + a]) & (ids != self.anchors["id"][first + a])
            if (floor := best.floor()) is not None:
                fits &= column >= floor
            best.add(column[fits], ids[fits])

    def out(self) -> Iterator[pa.RecordBatch]:
        kept = [(a, i, s) for a, best in zip(self.anchors["id"], self.best) for i, s in zip(best.id, best.score)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in kept], pa.int64()) for c in range(3)], ["anchor_id", "id", "score"]
        )


class _Negatives:
    """The best rows of other labels in the band of each positive."""

    def __init__(self, anchors: dict, bands: dict, k: int) -> None:
        self.anchors = anchors
        # By anchor: (positive, its score, lowest and highest score of the band).
        self.bands = [[(*p, Best(k)) for p in bands.get(a, [])] for a in anchors["id"]]

    def rows(self, some: slice, labels: np.ndarray) -> np.ndarray | None:
        return None if any(self.bands[some]) else np.zeros(0, np.int64)

    def add(self, first: int, found: np.ndarray, ids: np.ndarray, labels: np.ndarray) -> None:
        for a in range(found.shape[1]):
            other, column = labels != self.anchors["label"][first + a], found[:, a]
            for _, _, low, high, best in self.bands[first + a]:
                floor = best.floor()
                fits = (column >= (low if floor is None else max(low, floor))) & (column <= high) & other
                if fits.any():
                    best.add(column[fits], ids[fits])

    def out(self) -> Iterator[pa.RecordBatch]:
        kept = [
            (a, p, score, i, s)
            for a, bands in zip(self.anchors["id"], self.bands)
            for p, score, _, _, best in bands
            for i, s in zip(best.id, best.score)
        ]
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in kept], pa.int64()) for c in range(5)], names)


def band(score: int, low: int = 30, high: int = 90) -> tuple[int, int]:
    """The scores n with low * score <= 100 * n <= high * score."""
    return -(-low * score // 100), high * score // 100


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label: Column | str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    k: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor (``is_anchor``, a condition on ``id``) and each of its ``positives``
    nearest rows of the same label, the ``k`` nearest rows of other labels whose score is
    between ``low`` and ``high`` hundredths of the positive's.
    """
    spark = rows.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    valid = cut(_usable(rows, id_col, label, vector_col, scale))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    lengths = valid.groupBy(F.size("x").alias("dims")).agg(
        F.count(F.lit(1)).alias("n"), F.min(F.array_min("x")).alias("least"), F.max(F.array_max("x")).alias("most")
    )
    size = lengths.orderBy(F.desc("n"), F.desc("dims")).first()
    if size is None:
        return spark.createDataFrame([], schema)
    dims, n = size["dims"], size["n"]
    bits = 1 + max(int(size["most"]).bit_length(), int(-size["least"] - 1).bit_length() if size["least"] < 0 else 0)
    valid = valid.where(F.size("x") == dims)
    parts = max(-(-n // TASK_ROWS), min(2 * spark.sparkContext.defaultParallelism, -(-n // BATCH)))
    coded = cut(_coded(valid, dims, bits, parts))
    anchors = valid.where(is_anchor)
    rounds = -(-anchors.count() // ROUND)
    shape = (bits, -(-dims // 8))
    out = None
    for step in range(rounds):
        mine = anchors.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == step).select("id", "label", "x").collect()
        mine.sort(key=lambda r: (r["label"], r["id"]))
        sets = {"id": np.array([r["id"] for r in mine], np.int64), "label": np.array([r["label"] for r in mine]), "x": np.array([r["x"] for r in mine], np.int64).reshape(-1, dims)}
        sent = spark.sparkContext.broadcast((sets, None))
        found = _stream(coded, sent, shape, lambda a, _: _Positives(a, positives), "anchor_id long, id long, score long")
        best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
        near = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= positives)
        bands: dict = {}
        for r in near.collect():
            bands.setdefault(r["anchor_id"], []).append((r["id"], r["score"], *band(r["score"], low, high)))
        sent = spark.sparkContext.broadcast((sets, bands))
        found = _stream(
            coded,
            sent,
            shape,
            lambda a, b: _Negatives(a, b, k),
            "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long",
        )
        best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
        hard = cut(found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k))
        out = hard if out is None else out.unionByName(hard)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.col("label").cast("long").alias("label"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives(rows, F.col("id") % 100 == 0, label=moved)
    return found.select(*[F.col(c).cast("long").alias(c) if c.endswith("_id") else F.col(c) for c in found.columns])


OP11_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda c: CAST(floor(256 * CAST(c AS DOUBLE)) AS BIGINT)) AS x
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
c AS (SELECT id, label, unnest(x) AS c, generate_subscripts(x, 1) AS i FROM v),
s AS (SELECT a.id AS anchor, b.id, a.label = b.label AS alike, CAST(sum(a.c * b.c) AS BIGINT) AS score
      FROM c a JOIN c b ON a.i = b.i AND a.id % 100 = 0 AND a.id <> b.id GROUP BY ALL),
p AS (SELECT anchor, id, score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5)
SELECT p.anchor AS anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS "rank",
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.alike AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY "rank" <= 10
"""
