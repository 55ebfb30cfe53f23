"""Approximate nearest neighbours by multi-index hashing.

1. A rotation is learnt on a bounded sample (iterative quantisation: principal
   axes, then rotations that bring the sample closest to the corners of a cube).
   A vector's code has one bit for the sign of each rotated axis, 64 at most.
2. The search radius is learnt too: nearly all true neighbours inside the sample
   are within it.  Neighbours in the whole table are nearer, so it errs on the
   safe side.
3. A code is split into substrings of ``sub_bits``, and each is indexed.  If two
   codes differ in at most r bits, they differ in at most floor(r / m) bits in some
   of the m substrings (one less is enough for the later ones), so probing the
   values near the query's substrings retrieves every code within the radius.
4. The codes found are checked on all bits and ranked by the exact distance of
   the vectors.  A query that finds too few widens its radius until it has k.

Rows are dealt into shards and queries into blocks of bounded size.  One task
indexes one shard and searches one block in it, so what a task holds is bounded,
and each gives k rows per query.  Equal vectors are kept k + 1 times in the index
and searched once, which changes no result.

Vectors that are null, zero, of another length than most, or hold a null or a
non-finite number take no part; nor do null ids.  Of rows with the same id the
smallest vector counts.  Ties go to the smaller id.  Extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coloom.llm.common import table
from coloom.session import cut

#: Vectors that the rotation and the radius are learnt from, at most.
SAMPLE = 8192
#: Rows of a shard and queries of a block, about.
SHARD_ROWS, BLOCK_ROWS = 8192, 2048


def learn_rotation(x: np.ndarray, bits: int, rounds: int = 30, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """The mean, and the axes (dims x bits) of the code."""
    mean = x.mean(0)
    centred = x - mean
    axes = np.linalg.eigh(centred.T @ centred)[1][:, ::-1][:, :bits]
    v = centred @ axes
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(rounds):
        u, _, w = np.linalg.svd(np.where(v @ turn >= 0, 1.0, -1.0).T @ v)
        turn = (u @ w).T
    return mean, axes @ turn


def encode(x: np.ndarray, mean: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """The codes, as bits (rows x bits)."""
    return ((x - mean) @ axes >= 0).astype(np.uint8)


def learn_radius(x: np.ndarray, codes: np.ndarray, k: int, share: float, queries: int = 256) -> int:
    """The distance of codes that holds ``share`` of the k nearest in the sample."""
    found = []
    for i in range(0, len(x), max(1, len(x) // queries)):
        far = ((x - x[i]) ** 2).sum(1)
        far[i] = np.inf
        near = np.argsort(far, kind="stable")[: min(k, len(x) - 1)]
        found.append((codes[near] != codes[i]).sum(1))
    far = np.concatenate(found) if found else np.zeros(1)
    return int(np.ceil(np.quantile(far, share))) if len(far) else codes.shape[1]


class MultiIndex:
    """Substring tables over the codes of one shard."""

    def __init__(self, codes: np.ndarray, sub_bits: int) -> None:
        self.bits = codes.shape[1]
        self.cuts = [range(a, min(a + sub_bits, self.bits)) for a in range(0, self.bits, sub_bits)]
        self.packed = _pack(codes)
        self.tables = []
        for c in self.cuts:
            values = self.values(codes, c)
            order = np.argsort(values, kind="stable")
            self.tables.append((order, np.searchsorted(values[order], np.arange((1 << len(c)) + 1))))
        self.flips = {
            n: [np.array([sum(1 << b for b in f) for f in combinations(range(n), t)], np.int64) for t in range(n + 1)]
            for n in {len(c) for c in self.cuts}
        }

    @staticmethod
    def values(codes: np.ndarray, c: range) -> np.ndarray:
        return codes[:, c.start : c.stop].astype(np.int64) @ (1 << np.arange(len(c)))

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """The rows whose code differs from ``code`` in at most ``radius`` bits."""
        m = len(self.cuts)
        seen = np.zeros(len(self.packed), bool)
        for i, (c, (order, starts)) in enumerate(zip(self.cuts, self.tables, strict=True)):
            near = radius // m - (i > radius % m)
            own = int(self.values(code[None], c)[0])
            for flips in self.flips[len(c)][: near + 1]:
                for value in (own ^ flips).tolist():
                    seen[order[starts[value] : starts[value + 1]]] = True
        found = np.flatnonzero(seen)
        return found[np.bitwise_count(self.packed[found] ^ _pack(code[None])[0]) <= radius]


def _pack(codes: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(codes), 64), np.uint8)
    wide[:, : codes.shape[1]] = codes
    return np.packbits(wide, axis=1, bitorder="little").view("<u8").ravel()


def search_shard(
    ids: np.ndarray, x: np.ndarray, q: np.ndarray, model: tuple, k: int, sub_bits: int
) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the ids and the distances of its k nearest in the shard, nearest first."""
    mean, axes, radius = model
    index = MultiIndex(encode(x, mean, axes), sub_bits)
    out = []
    for vector, code in zip(q, encode(q, mean, axes), strict=True):
        reach = radius
        found = index.within(code, reach)
        while len(found) < min(k, len(x)):
            reach = min(reach + max(1, reach // 4), index.bits)
            found = index.within(code, reach)
        far = np.sqrt(((x[found] - vector) ** 2).sum(1))
        best = np.lexsort((ids[found], far))[:k]
        out.append((ids[found][best], far[best]))
    return out


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v): one valid vector per id, all of the most frequent length."""
    v = F.col("v")
    whole = rows.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")).where(
        F.col("id").isNotNull()
        & v.isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        & F.exists(v, lambda x: x != 0)
    )
    return whole.groupBy("id").agg(F.min("v").alias("v"))


def nearest(
    rows: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    sub_bits: int = 8,
    share: float = 0.98,
) -> DataFrame:
    """(query_id, rank, id, score): the k nearest other rows of the rows where ``is_query``, a condition on ``id``."""
    spark = rows.sparkSession
    valid = _usable(rows, id_col, vector_col)
    sizes = valid.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    schema = f"query_id {valid.schema['id'].dataType.simpleString()}, rank int, id {valid.schema['id'].dataType.simpleString()}, score double"
    if sizes is None:
        return spark.createDataFrame([], schema)
    valid = valid.where(F.size("v") == sizes["dims"]).select(
        "id", "v", F.xxhash64("v").alias("k1"), F.xxhash64(F.lit(1), "v").alias("k2")
    )
    same = Window.partitionBy("k1", "k2").orderBy("id")
    kept = cut(valid.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).drop("copy"))
    queries = valid.where(is_query).select("id", "k1", "k2")
    wanted = cut(valid.where(is_query).select("v", "k1", "k2").dropDuplicates(["k1", "k2"]))
    n, n_queries = kept.count(), wanted.count()

    hashed = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 30)) / (1 << 30)
    sample = kept.where(hashed < SAMPLE / n).limit(2 * SAMPLE).select("v").collect() or kept.limit(SAMPLE).select("v").collect()
    x = np.array([r["v"] for r in sample], np.float64)
    x = x[np.lexsort(x.T[::-1])]
    mean, axes = learn_rotation(x, min(64, sizes["dims"]))
    radius = learn_radius(x, encode(x, mean, axes), k, share)
    model = spark.sparkContext.broadcast((mean, axes, radius))

    shards, blocks = -(-n // SHARD_ROWS), max(1, -(-n_queries // BLOCK_ROWS))

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    index = kept.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), every(blocks).alias("block"))
    asked = wanted.select("k1", "k2", "v", F.pmod("k1", F.lit(blocks)).cast("int").alias("block"), every(shards).alias("shard"))
    kind = valid.schema["id"].dataType.simpleString()

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["k1", "k2", "id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], left.schema.field("id").type), pa.array([], pa.float64())], names)
        ids = left.column("id").to_numpy()
        vectors, q = (np.stack(t.column("v").to_numpy()).astype(np.float64) for t in (left, right))
        found = search_shard(ids, vectors, q, model.value, k + 1, sub_bits)
        sizes = [len(f[0]) for f in found]
        keys = [np.repeat(right.column(c).to_numpy(), sizes) for c in ("k1", "k2")]
        return pa.table([*keys, pa.array(np.concatenate([f[0] for f in found]), left.schema.field("id").type), np.concatenate([f[1] for f in found])], names)

    found = (
        index.groupBy("shard", "block")
        .cogroup(asked.groupBy("shard", "block"))
        .applyInArrow(search, f"k1 long, k2 long, id {kind}, score double")
    )
    best = Window.partitionBy("k1", "k2").orderBy("score", "id")
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k + 1).drop("rank")
    # Each query leaves itself out.
    own = Window.partitionBy("query_id").orderBy("score", "id")
    return (
        queries.withColumnRenamed("id", "query_id")
        .join(found, ["k1", "k2"])
        .where(F.col("query_id") != F.col("id"))
        .withColumn("rank", F.row_number().over(own))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "id", "score")
    )


def op1_nearest_neighbours(spark, sf_dir: str) -> DataFrame:
    found = nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0)
    return found.select(
        F.col("query_id").cast("long").alias("query_id"), "rank", F.col("id").cast("long").alias("vec_id"), "score"
    )
