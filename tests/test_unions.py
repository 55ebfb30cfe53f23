"""Sums over unions of groups in cells: bit sets of any width, tables of any size, cells dealt to several tasks."""

import numpy as np
import pyarrow as pa
import pytest

from coloom.operators import neighbors as N
from coloom.operators import unions as U


def lists(rng, n, groups, most):
    return [sorted(rng.choice(groups, rng.integers(0, most + 1), replace=False).tolist()) for _ in range(n)]


@pytest.mark.parametrize("groups,most", [(1, 1), (9, 5), (27, 14), (63, 6), (64, 6), (150, 9)])
@pytest.mark.parametrize("bits", [0, 3, 20])
def test_leading_sums(groups, most, bits):
    rng = np.random.default_rng(groups)
    left, right = lists(rng, 300, groups, most), lists(rng, 700, groups, most)
    a, b, dims = U.bit_sets(*[pa.chunked_array([pa.array(s, pa.list_(pa.int64()))]) for s in (left, right)])
    values, upto = rng.random((2, 700)), rng.integers(0, 701, 300)
    upto[:3] = 0, 700, 1
    got = U.leading_sums(a, upto, b, values, dims, bits)
    free = np.array([[not set(p) & set(q) for q in right] for p in left]) & (np.arange(700) < upto[:, None])
    assert np.allclose(got, values @ free.T)


def test_table_equals_tiles():
    """Few numbers and many rows go to the table, the same rows with none of it to the tiles."""
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 1 << 7, (3000, 1)).astype(np.uint64), rng.integers(0, 1 << 7, (5000, 1)).astype(np.uint64)
    values, upto = rng.random((3, 5000)), rng.integers(0, 5001, 3000)
    want = np.zeros((3, 3000))
    U._tiles(want, np.arange(3000), a, upto, b, values)
    for bits in (2, 5, 7):
        assert np.allclose(U.leading_sums(a, upto, b, values, 7, bits), want)


def test_wide_signatures(spark, monkeypatch):
    """1,500 people in 10 to 14 of 28 groups each, nearly all in a set of their own: no row for two sets that meet."""

    def refuse(*args, **kw):
        raise AssertionError("sets were paired")

    monkeypatch.setattr(N, "meetings", refuse)
    rng = np.random.default_rng(2)
    sets = [set(rng.choice(28, rng.integers(10, 15), replace=False).tolist()) for _ in range(1500)]
    m = spark.createDataFrame([(i, g) for i, s in enumerate(sets) for g in s], "node long, clique long")
    values = spark.createDataFrame([(i, float(i), i * 10**6) for i in range(1500)], "node long, x double, big long")
    got = {r.node: (r.degree, r.sum_x, r.sum_big) for r in N.neighbor_sums(m, values, ["x", "big"]).collect()}
    inside = np.array([[g in s for g in range(28)] for s in sets], float)
    near = (inside @ inside.T) > 0
    np.fill_diagonal(near, False)
    x = np.arange(1500.0)
    assert got == {i: (int(near[i].sum()), float(near[i] @ x), int(near[i] @ x) * 10**6) for i in range(1500)}
