"""Gradients of the graph networks against finite differences, and that the loss falls."""

import random

import numpy as np
import pytest

from coloom.operators import graph_networks as G
from tests.test_crowds import groups, near


def fixture(spark, n=20):
    rng = random.Random(2)
    members = {f"g{i}": rng.sample(range(n - 2), rng.randint(2, 6)) for i in range(7)}
    rows = [(i, i % 2, "test" if i % 5 == 4 else "train", rng.gauss(0, 1) + i % 2, rng.gauss(0, 1), rng.random()) for i in range(n)]
    table = spark.createDataFrame(rows, "node long, label int, split string, a double, b double, c double")
    return members, rows, table, groups(spark, members)


def plain_loss(kind, members, rows, w, slope=0.2):
    around, n = near(members), len(rows)
    x, y = np.array([r[3:] for r in rows]), np.array([r[1] for r in rows], float)
    if kind == "gcn":
        a = np.eye(n)
        for i, s in around.items():
            a[i, list(s)] = 1
        d = 1 / np.sqrt(a.sum(1))
        a = a * d[:, None] * d[None]
        z = a @ np.maximum(a @ x @ w["W"], 0) @ w["u"] + w["b"][0]
    else:
        h = x @ w["W"]
        s, t, q = h @ w["a1"], h @ w["a2"], h @ w["v"]
        z = q.copy()
        for i, js in around.items():
            e = np.array([s[i] + t[j] for j in sorted(js)])
            e = np.exp(np.where(e > 0, e, slope * e))
            z[i] = (e * q[sorted(js)]).sum() / e.sum()
        z = z + w["b"][0]
    train = np.array([r[2] == "train" for r in rows])
    return (np.logaddexp(0, z) - z * y)[train].mean()


@pytest.mark.parametrize("kind", ["gcn", "gat"])
def test_gradient(spark, kind):
    members, rows, table, m = fixture(spark)
    w = G.start_weights(kind, 3, 4, 1)
    w["b"] = np.array([0.1])
    loss, grad = G.Network(kind, table, ["a", "b", "c"], m).step(w)
    assert abs(loss - plain_loss(kind, members, rows, w)) < 1e-12
    for k, v in w.items():
        for at in np.ndindex(v.shape):
            ends = []
            for d in (1e-6, -1e-6):
                moved = {n: u.copy() for n, u in w.items()}
                moved[k][at] += d
                ends.append(plain_loss(kind, members, rows, moved))
            assert abs(grad[k][at] - (ends[0] - ends[1]) / 2e-6) < 1e-7, (k, at)


@pytest.mark.parametrize("kind", ["gcn", "gat"])
def test_training(spark, kind):
    _, _, table, m = fixture(spark)
    net = G.Network(kind, table, ["a", "b", "c"], m)
    w, losses = net.train(G.start_weights(kind, 3, 4, 1), epochs=4, rate=0.1)
    assert losses == sorted(losses, reverse=True)
    out = net.scores(w).collect()
    assert len(out) == 20 and all(0 < r.score < 1 for r in out)
    assert np.isfinite(net.step(w)[0]) and net.step(w)[0] < losses[-1]
