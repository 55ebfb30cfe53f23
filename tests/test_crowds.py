"""Attention and betweenness on groups against plain ones, large groups included."""

import math
import random

import pytest

from coloom.operators import centrality as C
from coloom.operators import embedding as E
from coloom.operators.neighbors import threshold_sums
from tests.test_graph import brandes


def groups(spark, members):
    return spark.createDataFrame([(n, g) for g, nodes in members.items() for n in nodes], "node long, clique string").distinct()


def near(members):
    out = {}
    for nodes in members.values():
        for n in nodes:
            out.setdefault(n, set()).update(set(nodes) - {n})
    return {n: s for n, s in out.items() if s}


def overlapping(seed, n=60, k=9, size=25):
    rng = random.Random(seed)
    return {f"g{i}": rng.sample(range(n), rng.randint(1, size)) for i in range(k)} | {"alone": [n + 5], "twins": [n + 1, n + 2]}


@pytest.mark.parametrize("fanout,narrow", [(50, 8), (10, 8), (2, 8), (2, 1), (2, 0), (12, 2)])
def test_threshold_sums(spark, fanout, narrow):
    members = overlapping(fanout + narrow)
    rng = random.Random(9)
    rows = [(n, float(rng.randint(-3, 3)), float(rng.randint(-4, 4)), rng.random(), rng.random()) for n in range(70)]
    df = spark.createDataFrame(rows, "node long, x double, at double, a double, b double")
    got = {r.node: (r.a, r.b) for r in threshold_sums(groups(spark, members), df, ["a"], ["b"], fanout, narrow, 4).collect()}
    of = {r[0]: r for r in rows}
    want = {
        n: (sum(of[j][3] for j in s if of[j][1] <= of[n][2]), sum(of[j][4] for j in s if of[j][1] > of[n][2])) for n, s in near(members).items()
    }
    assert set(got) == set(want)
    assert all(abs(x - y) < 1e-9 for n in want for x, y in zip(got[n], want[n]))


def slow_attention(members, hidden, slope=0.2):
    of = {r[0]: r for r in hidden}
    leaky = lambda e: e if e > 0 else e * slope
    out = {n: math.tanh(r[1][0]) for n, r in of.items()}
    for n, s in near(members).items():
        w = {j: math.exp(leaky(of[n][2] + of[j][3])) for j in s}
        out[n] = math.tanh(sum(w[j] * of[j][1][0] for j in s) / sum(w.values()))
    return out


@pytest.mark.parametrize("fanout", [50, 8])
def test_attention_overlapping(spark, fanout):
    members = overlapping(3)
    rng = random.Random(4)
    hidden = [(n, [rng.gauss(0, 1)], rng.gauss(0, 2), rng.gauss(0, 2)) for n in range(70)]
    df = spark.createDataFrame(hidden, "node long, g array<double>, s double, t double")
    got = {r.node: r.att_0 for r in E.attention(groups(spark, members), df, 1, fanout=fanout).collect()}
    want = slow_attention(members, hidden)
    assert set(got) == set(want) and all(abs(got[n] - want[n]) < 1e-9 for n in want)


def test_attention_crowd(spark):
    """5,000 members of one group, some of them in others too; nothing is written out in pairs."""
    import numpy as np

    rng = np.random.default_rng(5)
    n = 5000
    g, s, t = rng.normal(0, 1, n), rng.normal(0, 2, n), rng.normal(0, 2, n)
    more = {"b": range(4900, 5200), "c": range(5190, 5210)}
    hidden = [(i, [float(g[i])], float(s[i]), float(t[i])) for i in range(n)] + [(i, [0.5], 0.1, -0.2) for i in range(n, 5210)]
    members = {"a": range(n), **more}
    df = spark.createDataFrame(hidden, "node long, g array<double>, s double, t double")
    out = E.attention(groups(spark, members), df, 1)
    got = {r.node: r.att_0 for r in out.collect()}
    all_g = np.concatenate([g, np.full(210, 0.5)])
    all_s, all_t = np.concatenate([s, np.full(210, 0.1)]), np.concatenate([t, np.full(210, -0.2)])
    for i in (0, 17, 4899, 4900, 4999, 5000, 5195, 5209):
        js = sorted(set().union(*[set(v) for v in members.values() if i in v]) - {i})
        e = all_s[i] + all_t[js]
        w = np.exp(np.where(e > 0, e, 0.2 * e))
        assert abs(got[i] - math.tanh((w * all_g[js]).sum() / w.sum())) < 1e-9
    assert len(got) == 5210


@pytest.mark.parametrize("seed,narrow,block", [(1, 8, 4096), (2, 2, 4096), (3, 0, 7), (4, 8, 5)])
def test_betweenness_of_groups(spark, seed, narrow, block):
    members = overlapping(seed, 40, 12, 7)
    want = brandes(near(members))
    n = 50
    got = {r.node: r.betweenness for r in C.betweenness(groups(spark, members), n, block=block, narrow=narrow).collect()}
    assert set(got) == set(want)
    assert all(abs(got[v] - want[v] / ((n - 1) * (n - 2))) < 1e-10 for v in want)


def test_betweenness_crowd(spark):
    """A group of 2,000, a bridge out of it, and two groups that overlap in a third of it."""
    members = {"a": list(range(2000)), "b": [0, 5000], "c": [5000, 5001, 5002], "d": [*range(1400, 2000), 6000], "e": [6000, 6001]}
    n = 6002
    got = {r.node: r.betweenness * (n - 1) * (n - 2) for r in C.betweenness(groups(spark, members), n).collect()}
    inside, tail, far = 2000, 3, 2  # 5000..5002 behind node 0, 6000 and 6001 behind a third
    third = 600
    # Ordered pairs through node 0: from its tail to all others and back.
    assert abs(got[0] - 2 * tail * (inside - 1 + far)) < 1e-6
    # From 6000 and 6001 to the rest of the crowd, and to the tail through node 0: each of the third carries its share.
    assert abs(got[1500] - 2 * far * (inside - third + tail) / third) < 1e-6
    assert abs(got[6000] - 2 * (inside + tail)) < 1e-6 and abs(got[5000] - 2 * 2 * (inside + far)) < 1e-6
    assert got[7] == 0 and got[5001] == 0 and got[6001] == 0
