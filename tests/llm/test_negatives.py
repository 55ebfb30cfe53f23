"""Scores from subset sums, and hard negatives against all scores."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coloom.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label long, id int, x string"


def slow(rows, positives=5, k=10):
    """The result over [(id, vector, label)] of valid rows."""
    ints = [(i, [math.floor(256 * c) for c in v], label) for i, v, label in rows]
    out = []
    for a, va, la in ints:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(va, v)), i, label) for i, v, label in ints if i != a)
        for p, pid, _ in [r for r in scored if r[2] == la][:positives]:
            fits = [r for r in scored if r[2] != la and 30 * -p <= 100 * -r[0] <= 90 * -p]
            out += [(a, pid, rank, i, -p, -s) for rank, (s, i, _) in enumerate(fits[:k], 1)]
    return sorted(out)


def got(spark, rows, **more):
    df = spark.createDataFrame([(i, v, label, 0, "x") for i, v, label in rows], SCHEMA)
    return sorted(tuple(r) for r in N.hard_negatives(df, F.col("id") % 100 == 0, **more).collect())


@pytest.mark.parametrize("bits,dims", [(1, 8), (4, 3), (10, 64), (27, 17)])
def test_scores(bits, dims):
    rng = np.random.default_rng(bits)
    x = rng.integers(-(1 << bits - 1), 1 << bits - 1, (300, dims))
    a = rng.integers(-(1 << bits - 1), 1 << bits - 1, (9, dims))
    assert (N.scores(N.planes(x, bits), N.subset_sums(a)) == x @ a.T).all()


@pytest.mark.parametrize("seed,labels,values", [(1, 3, 4), (2, 10, 1000), (3, 1, 3), (4, 2, 1)])
def test_against_all_scores(spark, seed, labels, values):
    """Ties, copies, one label alone, zero and negative scores."""
    rnd = random.Random(seed)
    rows = [(i, [rnd.randint(-1, values) / max(values, 2) for _ in range(5)], rnd.randrange(labels)) for i in range(0, 900, 3)]
    rows += [(1000 + i, [0.5, 0.25, 0.0, 0.0, -0.01], i % 2) for i in range(150)]
    assert got(spark, rows) == slow(rows)
    assert got(spark, rows, positives=2, k=1) == slow(rows, 2, 1)


def test_rounds(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i * 20, [rnd.gauss(0, 1) for _ in range(9)], rnd.randrange(2)) for i in range(120)]
    want = got(spark, rows)
    assert want == slow(rows)
    monkeypatch.setattr(N, "ROUND", 7)
    monkeypatch.setattr(N, "BATCH", 16)
    assert got(spark, rows) == want


def test_edge_rows(spark):
    rnd = random.Random(6)
    good = [(i, [rnd.gauss(0, 1), rnd.random()], rnd.randrange(2)) for i in range(0, 200)]
    bad = [(300, None, 1), (301, [1.0, None], 1), (302, [math.nan, 1.0], 0), (303, [math.inf, 1.0], 0), (304, [], 1), (305, [1.0], 1), (306, [1.0, 2.0], None), (None, [1.0, 2.0], 1), (307, [1e30, 0.0], 1)]
    assert got(spark, good + bad + good[:50]) == slow(good)
    assert got(spark, bad[:1]) == [] and got(spark, []) == []
    assert got(spark, [r for r in good if r[0] % 100]) == []


def test_text_labels(spark):
    rows = [(0, [1.0], "a"), (1, [1.0], "a"), (2, [0.5], "b"), (3, [0.95], "b")]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<float>, label string")
    assert [tuple(r) for r in N.hard_negatives(df, F.col("id") == 0).collect()] == [(0, 1, 1, 2, 65536, 32768)]
