"""Neighbours against all distances."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coloom.llm import ann


def slow(rows, queries, k):
    """{query: [(id, distance)]} over {id: vector}."""
    out = {}
    for q in queries:
        far = [(math.dist(rows[q], v), i) for i, v in rows.items() if i != q]
        out[q] = [(i, d) for d, i in sorted(far)[:k]]
    return out


def by_query(found):
    out = {}
    for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r)
    return out


def test_codes_within_radius():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2, (3000, 40), dtype=np.uint8)
    index = ann.MultiIndex(codes, 8)
    for radius in (0, 1, 4, 9, 13, 20, 40):
        for i in (0, 7):
            want = np.flatnonzero((codes != codes[i]).sum(1) <= radius)
            assert (index.within(codes[i], radius) == want).all()


def test_edge_rows(spark):
    rows = [(i, [float(i % 7), 1.0, float(i // 7)]) for i in range(40)]
    rows += [(100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 2.0]), (103, [1.0, float("nan"), 2.0]), (104, [float("inf"), 1.0, 1.0])]
    rows += [(105, [1.0, 2.0]), (None, [1.0, 1.0, 1.0]), (3, [3.0, 1.0, 0.0]), (3, [9.0, 9.0, 9.0])]
    rows += [(200 + i, [2.0, 1.0, 2.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as k1", "'x' as score")
    valid = {i: v for i, v in rows if i is not None and i < 40 or i is not None and i >= 200}
    valid[3] = [3.0, 1.0, 0.0]
    got = by_query(ann.nearest(df, F.col("id") % 2 == 0, k=5, share=1.0))
    want = slow(valid, [i for i in valid if i % 2 == 0], 5)
    assert {q: [(r.id, round(r.score, 9)) for r in v] for q, v in got.items()} == {q: [(i, round(d, 9)) for i, d in v] for q, v in want.items()}
    assert ann.nearest(df.limit(0), F.col("id") % 2 == 0).count() == 0
    few = ann.nearest(df.where("vec_id in (1, 2, 4)"), F.col("id") == 2).collect()
    assert [r.id for r in sorted(few, key=lambda r: r["rank"])] == [1, 4]


@pytest.mark.parametrize("rows", [8, 200, 5])
def test_shards_do_not_matter(spark, monkeypatch, rows):
    monkeypatch.setattr(ann, "SHARD_ROWS", rows)
    monkeypatch.setattr(ann, "BLOCK_ROWS", max(2, rows // 4))
    rng = random.Random(rows)
    data = {i: [float(np.float32(rng.gauss(0, 1))) for _ in range(4)] for i in range(60)}
    df = spark.createDataFrame(list(data.items()), "vec_id long, embedding array<float>")
    got = by_query(ann.nearest(df, F.col("id") % 10 == 0, k=3, share=1.0))
    want = slow(data, range(0, 60, 10), 3)
    hits = sum(len({r.id for r in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 18 and all(len(v) == 3 for v in got.values())


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    ids = np.array(sorted(rows))
    x = np.array([rows[i] for i in ids], np.float64)
    got = by_query(ann.op1_nearest_neighbours(spark, sf))
    hits = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - np.array(rows[q], np.float64)) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        assert [r["rank"] for r in got[q]] == list(range(1, 11))
        assert all(abs(r.score - far[np.searchsorted(ids, r.vec_id)]) < 1e-12 for r in got[q])
        hits += len({r.vec_id for r in got[q]} & set(ids[order]))
    assert hits >= 0.9 * 10 * len(got) and len(got) == (ids % 100 == 0).sum()
    print("recall", hits / 10 / len(got))
