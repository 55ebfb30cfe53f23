"""Components of few edges in one partition are those of the exchanged rounds."""

from __future__ import annotations

import random

import pytest

from coloom.operators import components as C

rng = random.Random(5)
CASES = {
    "random": [(rng.randrange(900), rng.randrange(900)) for _ in range(500)],
    "chain": [(i, i + 1) for i in range(60)],
    "star, repeated, loops": [(0, i % 40) for i in range(120)] + [(7, 7)],
    "empty": [],
}


def slow(edges):
    root = {x: x for e in edges for x in e if e[0] != e[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("one_task", [0, 10_000])
def test_components(spark, name, one_task):
    d = spark.createDataFrame(CASES[name], "u long, v long").repartition(7)
    assert {r.node: r.component for r in C.components(d, one_task).collect()} == slow(CASES[name])


def test_small_rounds_exchange_nothing(spark):
    e = C.cut(C._small_star(spark.createDataFrame(CASES["random"], "u long, v long"))).coalesce(1)
    plan = C._small_star(C._large_star(e, True), True)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan
