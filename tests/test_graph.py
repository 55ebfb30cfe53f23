import datetime as dt
import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from coloom.operators import centrality as C
from coloom.operators import colocation as L
from coloom.operators import embedding as E
from coloom.operators import hetero as H
from coloom.operators import network as N
from coloom.operators.components import components, member_components
from coloom.operators.neighbors import decayed_sums, neighbor_sums

DAY = dt.date(2020, 1, 1)


def visits(spark, rows):
    data = [(c, p, v, DAY + dt.timedelta(d)) for c, p, v, d in rows]
    return spark.createDataFrame(data, "case_id long, province string, venue string, day date")


# a, b same day; c three days later; d far away; e elsewhere
BASIC = [(1, "p", "v", 0), (2, "p", "v", 0), (3, "p", "v", 3), (4, "p", "v", 10), (5, "q", "v", 0)]


@pytest.fixture(scope="module")
def crowd():
    rng = random.Random(3)
    rows = []
    for c in range(50):
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6, 9])):
            rows.append((c, str(rng.randrange(2)), str(rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6, 7])), rng.randrange(12)))
    return rows


def brute(rows, k):
    """Distinct neighbours with their smallest day distance."""
    gaps = {}
    for (a, p, v, d), (b, q, w, e) in itertools.product(rows, rows):
        if a != b and (p, v) == (q, w) and abs(d - e) <= k:
            gaps[a, b] = min(gaps.get((a, b), k), abs(d - e))
    return gaps


def neighbours(gaps):
    out = {}
    for a, b in gaps:
        out.setdefault(a, set()).add(b)
    return out


def edge_set(m):
    return {(r.src, r.dst) for r in L.pairs(m).collect()}


def as_groups(spark, pairs):
    """Edges as groups of two."""
    return spark.createDataFrame([(n, f"{a}-{b}") for a, b in pairs for n in (a, b)], "node long, clique string")


def test_known_edges_and_labels(spark):
    v = visits(spark, BASIC)
    assert edge_set(L.members(v, 0)) == {(1, 2)}
    assert edge_set(L.members(v, 3)) == {(1, 2), (1, 3), (2, 3)}
    assert edge_set(L.members(v, 6)) == {(1, 2), (1, 3), (2, 3)}
    assert edge_set(L.members(v, 7)) == {(1, 2), (1, 3), (2, 3), (3, 4)}
    labels = {r.case_id: (r.label_0, r.label_3) for r in L.cluster_labels(v, [0, 3]).collect()}
    assert labels == {1: (1, 1), 2: (1, 1), 3: (0, 1)}
    weights = {(r.src, r.dst): (r.min_gap, round(r.weight, 9)) for r in L.pair_gaps(L.band_edges(v, 3)).collect()}
    assert weights == {(1, 2): (0, 1.0), (1, 3): (3, round(math.exp(-3 / 7), 9)), (2, 3): (3, round(math.exp(-3 / 7), 9))}


def test_multigraph_and_large_groups(spark, monkeypatch):
    two = visits(spark, [(1, "p", "v", 0), (2, "p", "v", 0), (1, "p", "w", 0), (2, "p", "w", 0)])
    assert L.pairs(L.members(two), multigraph=True).count() == 2
    assert L.pairs(L.members(two)).count() == 1
    monkeypatch.setattr(L, "BLOCK", 30)
    for size in (49, 50, 300):
        v = visits(spark, [(i, "p", "v", 0) for i in range(size)])
        want = size * (size - 1) // 2
        assert L.pairs(L.members(v)).count() == L.pair_gaps(L.band_edges(v, 0)).count() == want
        assert [r.n for r in L.edges(L.members(v)).collect()] == [size] * size
        assert H.case_edge_count(v).first().n_edges == H.case_edges(v).count() == want


@pytest.mark.parametrize("size", [49, 50, 5000])
def test_measures_of_one_group(spark, size):
    v = spark.range(size).selectExpr("id as case_id", "'p' as province", "'v' as venue", "date'2020-01-01' as day")
    m = L.members(v)
    assert {(r.degree, r.closed) for r in C.transitivity_share(m).collect()} == {(size - 1, size - 1)}
    days = v.selectExpr("case_id as node", "cast(case_id * 3 as int) as day")
    assert {round(r.proximity, 9) for r in E.temporal_proximity(m, days, 3.0).collect()} == {round(math.exp(-1), 9)}
    x = v.selectExpr("case_id as node", "cast(case_id as double) as x")
    assert {round(r.x, 6) for r in E.gcn_propagate(m, x, ["x"]).collect()} == {(size - 1) / 2}
    assert neighbor_sums(m).agg(F.sum("degree")).first()[0] == size * (size - 1)


def test_measures_of_overlapping_groups(spark, crowd):
    v, near = visits(spark, crowd), neighbours(brute(crowd, 2))
    m = L.members(v, 2)
    want = {a: (len(s), sum(1 for b in s if near[b] & s - {a})) for a, s in near.items()}
    assert {r.node: (r.degree, r.closed) for r in C.transitivity_share(m).collect()} == want
    days = spark.createDataFrame([(i, i * 7 % 40) for i in range(50)], "node long, day int")
    got = {r.node: round(r.proximity, 9) for r in E.temporal_proximity(m, days).collect()}
    assert got == {a: round(math.exp(-min(abs(a * 7 % 40 - b * 7 % 40) for b in s) / 7), 9) for a, s in near.items()}
    x = spark.createDataFrame([(i, float(i * i % 17)) for i in range(50)], "node long, x double")
    deg = {i: len(near.get(i, ())) + 1 for i in range(50)}
    got = {r.node: round(r.x, 9) for r in E.gcn_propagate(m, x, ["x"]).collect()}
    assert got == {i: round(sum(j * j % 17 / math.sqrt(deg[i] * deg[j]) for j in {i} | near.get(i, set())), 9) for i in range(50)}


def test_many_hot_days_stay_near_linear(spark):
    """Everyone at one place on nine days: one signature, so the cost is that of the memberships."""
    v = spark.range(6000).selectExpr("id as case_id", "'p' as province", "'v' as venue", "explode(sequence(0, 8)) as d")
    v = v.selectExpr("case_id", "province", "venue", "date_add(date'2020-01-01', d * 2) as day")
    assert {r.degree for r in neighbor_sums(L.members(v)).collect()} == {5999}


@pytest.mark.parametrize("k", [0, 2])
def test_labels_and_band_edges_match_brute_force(spark, crowd, k):
    v, gaps = visits(spark, crowd), brute(crowd, k)
    near = neighbours(gaps)
    labels = {r.case_id for r in L.cluster_labels(v, [k]).collect() if r[1] == 1}
    assert labels == set(near)
    got = {(r.src, r.dst): r.min_gap for r in L.pair_gaps(L.band_edges(v, k)).collect()}
    assert got == {p: g for p, g in gaps.items() if p[0] < p[1]}


@pytest.mark.parametrize("k,fanout,narrow", [(0, 50, 8), (0, 3, 2), (2, 50, 8), (2, 3, 8), (2, 3, 1), (2, 4, 0), (2, 2, 3)])
def test_neighbor_sums_match_brute_force(spark, crowd, k, fanout, narrow):
    near = neighbours(brute(crowd, k))
    values = spark.createDataFrame([(i, float(i * i % 17)) for i in range(50)], "node long, x double")
    rows = neighbor_sums(L.members(visits(spark, crowd), k), values, ["x"], fanout=fanout, narrow=narrow).collect()
    got = {r.node: (r.degree, round(r.sum_x, 6)) for r in rows}
    assert got == {a: (len(s), round(sum(float(j * j % 17) for j in s), 6)) for a, s in near.items()}


def test_hot_group_and_hot_case_are_counted_without_pairs(spark):
    n = 4000
    everyone = spark.range(n).select(F.col("id").alias("case_id"), F.lit("p").alias("province"), F.lit("hot").alias("venue"))
    alone = spark.range(n).select(F.lit(0).cast("long").alias("case_id"), F.lit("p").alias("province"), F.col("id").cast("string").alias("venue"))
    friend = spark.range(10).select((F.col("id") + n).alias("case_id"), F.lit("p").alias("province"), F.col("id").cast("string").alias("venue"))
    v = everyone.unionByName(alone).unionByName(friend).withColumn("day", F.lit(DAY))
    got = {r.node: r.degree for r in neighbor_sums(L.members(v)).collect()}
    assert got[0] == n - 1 + 10
    assert all(got[i] == n - 1 for i in range(1, n)) and all(got[n + i] == 1 for i in range(10))


def test_decayed_sums_and_maxima_with_large_groups(spark, crowd):
    v, gaps = visits(spark, crowd), brute(crowd, 2)
    values = spark.createDataFrame([(i, float(i * i % 17)) for i in range(50)], "node long, x double")
    want = {}
    for (a, b), g in gaps.items():
        w = math.exp(-g / 7)
        s = want.get(a, (0.0, 0.0))
        want[a] = (s[0] + w, s[1] + w * (b * b % 17))
    got = {r.node: (r.weight, r.sum_x) for r in decayed_sums(v, values, ["x"], 2, fanout=4).collect()}
    assert set(got) == set(want)
    assert all(abs(x - y) < 1e-9 for a in want for x, y in zip(got[a], want[a]))
    best = {r.node: r.max_x for r in E.neighbor_maxima(L.members(v, 2), values, ["x"]).collect()}
    assert best == {a: max(float(j * j % 17) for j in s) for a, s in neighbours(gaps).items()}


def test_components_match_brute_force(spark, crowd):
    near = neighbours(brute(crowd, 0))
    want, seen = {}, set()
    for a in near:
        if a in seen:
            continue
        stack, comp = [a], {a}
        while stack:
            for b in near[stack.pop()]:
                if b not in comp:
                    comp.add(b)
                    stack.append(b)
        seen |= comp
        want.update({x: min(comp) for x in comp})
    got = {r.node: r.component for r in member_components(L.members(visits(spark, crowd))).collect()}
    assert got == want


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(300)], "u long, v long")
    got = components(chain).collect()
    assert len(got) == 301 and {r.component for r in got} == {0}


def brandes(near):
    bc = dict.fromkeys(near, 0.0)
    for s in near:
        dist, paths, order = {s: 0}, {s: 1}, [s]
        for v in order:
            for w in near[v]:
                if w not in dist:
                    dist[w], paths[w] = dist[v] + 1, 0
                    order.append(w)
                if dist[w] == dist[v] + 1:
                    paths[w] += paths[v]
        dep = dict.fromkeys(order, 0.0)
        for w in reversed(order):
            for v in near[w]:
                if dist[v] == dist[w] - 1:
                    dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                bc[w] += dep[w]
    return bc


def test_betweenness_and_transitivity_match_brute_force(spark):
    rng = random.Random(5)
    pairs = {tuple(sorted(rng.sample(range(25), 2))) for _ in range(40)}
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    edges = spark.createDataFrame(sorted(pairs), "src long, dst long")
    n = 30
    want = brandes(near)
    for block in (4096, 9):
        got = {r.node: r.betweenness for r in C.betweenness(edges, n, block=block).collect()}
        assert set(got) == set(want)
        assert all(abs(got[v] - want[v] / ((n - 1) * (n - 2))) < 1e-12 for v in want)
    share = {r.node: (r.degree, r.closed) for r in C.transitivity_share(as_groups(spark, pairs)).collect()}
    assert share == {a: (len(s), sum(1 for b in s if near[b] & s - {a})) for a, s in near.items()}


def test_betweenness_inside_tasks_and_by_rows(spark, monkeypatch):
    """Components of many sizes, twins and shared groups: walked inside tasks, by rows, or some either way."""
    from coloom.operators import paths

    rng = random.Random(7)
    rows = {(f"{p}{rng.randrange(16)}", f"{p}{g}") for p in "abc" for g in range(7) for _ in range(rng.randrange(2, 5))}
    rows |= {(f"t{i}", "t") for i in range(4)} | {("u0", "u"), ("u1", "u"), ("u1", "w"), ("u2", "w"), ("u3", "w"), ("x", "x")}
    near = {}
    for a, g in rows:
        for b, h in rows:
            if g == h and a != b:
                near.setdefault(a, set()).add(b)
    want = brandes(near)
    m = spark.createDataFrame(sorted(rows), "node string, clique string")
    monkeypatch.setattr(paths, "CELLS", 40)
    for most in (1 << 18, 25, 0):
        got = {r.node: r.betweenness * 99 * 98 for r in C.betweenness(m, 100, most=most).collect()}
        assert set(got) == set(want) and max(abs(got[v] - want[v]) for v in want) < 1e-9


def test_betweenness_of_small_components_writes_no_waves(spark, monkeypatch):
    """A row for each source and what it reaches, written out wave by wave, took minutes on ten thousand nodes."""
    edges = spark.createDataFrame([(i, i + 1) for i in range(300) if i % 100 != 99], "src long, dst long")

    def refuse(*_):
        raise AssertionError("rows of waves")

    monkeypatch.setattr(C, "_dependencies", refuse)
    got = {r.node: r.betweenness * 999 * 998 for r in C.betweenness(edges, 1000).collect()}
    assert set(got) == set(range(300))
    assert all(abs(b - 2 * (v % 100) * (99 - v % 100)) < 1e-9 for v, b in got.items())


def test_one_copy_of_a_graph_serves_many_blocks_of_sources(monkeypatch):
    """A graph went out anew with each block; many sources to a copy were walked all at once."""
    import numpy as np
    import pyarrow as pa
    from coloom.operators import paths

    near = {v: {v - 1, v + 1} & set(range(12)) for v in range(12)}
    near[2].add(9), near[9].add(2)
    arcs = [(a, b) for a in near for b in near[a] if a < b]
    columns = {"component": [7], "weights": [[1.0] * 12], "a": [[a for a, _ in arcs]], "b": [[b for _, b in arcs]], "first": [0], "step": [12]}
    monkeypatch.setattr(paths, "CELLS", 40)
    walk, blocks = paths.dependencies, []

    def seen(jobs):
        blocks.append([(len(w), last - first) for w, *_, first, last in jobs])
        return walk(jobs)

    monkeypatch.setattr(paths, "dependencies", seen)
    out = pa.Table.from_batches(paths._walk_batches([pa.RecordBatch.from_pydict(columns)])).to_pydict()
    assert all(sum(n * k for n, k in block) <= 40 for block in blocks) and sum(k for block in blocks for _, k in block) == 12
    got = np.bincount(out["i"], out["dep"], 12)
    want = brandes(near)
    assert set(out["component"]) == {7} and all(abs(got[v] - want[v]) < 1e-9 for v in want)


def test_path_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    for coded, value in ((False, 1.0), (True, 2.0)):
        got = {r.node: r.betweenness for r in C.betweenness(edges, 3, coded).collect()}
        assert got == {1: 0.0, 2: value, 3: 0.0}
    groups = as_groups(spark, [(1, 2), (2, 3)])
    assert {r.node: r.share for r in C.transitivity_share(groups).collect()} == {1: 0.0, 2: 0.0, 3: 0.0}


def test_triangle_and_isolate(spark):
    v = visits(spark, [(i, "p", "v", 0) for i in (1, 2, 3)] + [(4, "p", "w", 0)]).withColumn("s", F.lit("all"))
    r = N.slice_metrics(v, "s").first()
    assert (r.n_cases, r.n_edges, r.n_connected, r.avg_degree, r.lcc_size) == (4, 3, 3, 2.0, 3)
    assert r.density == 0.5 and r.lcc_ratio == 0.75
    share = C.transitivity_share(L.members(v))
    assert {x.node: x.share for x in share.collect()} == {1: 1.0, 2: 1.0, 3: 1.0}


def test_local_rank_matches_iteration(spark, crowd):
    near = neighbours(brute(crowd, 2))
    nodes = spark.range(50).withColumnRenamed("id", "node")
    got = {r.node: r.local_rank for r in C.local_rank(L.members(visits(spark, crowd), 2), nodes).collect()}
    for node in range(50):
        s = sum(1 / len(near[j]) for j in near.get(node, ()))
        r = 1 / 50
        for _ in range(5):
            r = 1 / 50 + 0.85 * r * s
        assert abs(got[node] - r) < 1e-12 * max(1, r)


def test_weekly_series_keeps_empty_weeks(spark):
    v = visits(spark, [(1, "p", "v", 0), (2, "p", "v", 0), (3, "p", "v", 20)])
    args = (DAY + dt.timedelta(7), DAY + dt.timedelta(14))
    rows = N.weekly_series(v, None, *args).orderBy("week_num").collect()
    assert [(r.week_num, r.n_events, r.n_edges, r.post, r.post_weeks) for r in rows] == [(0, 2, 1, 0, 0), (1, 0, 0, 1, 0), (2, 1, 0, 1, 1)]
    assert [r.lcc_ratio for r in rows] == [1.0, 0.0, 1.0]
    assert [r.week_num for r in N.weekly_series(v, None, *args, fill=False).orderBy("week_num").collect()] == [0, 2]


def test_isolation(spark):
    cases = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (9, 0)], "case_id long, flag int")
    labels = L.cluster_labels(visits(spark, BASIC), [0])
    rows = {r.flag: (r.n, r.isolated) for r in N.isolation(cases, labels, "label_0", "flag").collect()}
    assert rows == {1: (2, 1), 0: (2, 1)}


def test_attention_weights(spark):
    groups = as_groups(spark, [(1, 2), (1, 3)])
    hidden = spark.createDataFrame(
        [(1, [0.1], 0.5, 0.2), (2, [0.4], -0.5, 0.3), (3, [0.8], 0.1, -0.9), (4, [0.6], 0.0, 0.0)],
        "node long, g array<double>, s double, t double",
    )
    got = {r.node: r.att_0 for r in E.attention(groups, hidden, 1).collect()}
    w2, w3 = math.exp(0.8), math.exp(-0.4 * 0.2)
    assert abs(got[1] - math.tanh((w2 * 0.4 + w3 * 0.8) / (w2 + w3))) < 1e-12
    assert abs(got[2] - math.tanh(0.1)) < 1e-12 and abs(got[4] - math.tanh(0.6)) < 1e-12


def test_gcn_propagation(spark):
    groups = as_groups(spark, [(1, 2)])
    x = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, 5.0)], "node long, x double")
    got = {r.node: round(r.x, 9) for r in E.gcn_propagate(groups, x, ["x"]).collect()}
    assert got == {1: 3.0, 2: 3.0, 3: 5.0}


def test_indexed_edges_keep_their_place(spark):
    """Edges dealt by case were dealt by its text and then by item again."""
    from coloom.operators import hetero as H

    edges = spark.createDataFrame(
        [("case", "venue", 7, "v", 1.0), ("case", "date", 7, "d", 1.0), ("case", "case", 7, "8", 1.0), ("case", "venue", 9, "v", 1.0)],
        "src_type string, dst_type string, case_id long, item string, weight double",
    )
    nodes = spark.createDataFrame([("case", "7", 0), ("case", "8", 1), ("venue", "v", 0), ("date", "d", 0)], "node_type string, name string, idx long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = H.indexed_edges(edges, nodes)
        assert sorted((r.dst_type, r.src, r.dst) for r in got.collect()) == [("case", 0, 1), ("date", 0, 0), ("venue", 0, 0)]
        items = H.indexed_edges(edges.where("dst_type <> 'case'").repartition(4, "case_id"), nodes).where("dst_type <> 'case'")
        plan = items._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(case_id") == 2 and "Exchange hashpartitioning(item" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_band_graphs_of_crowded_and_other_places(spark, crowd):
    """Pairs of calm places and groups of crowded ones together are the graph, whichever of them there are."""
    from coloom.operators.neighbors import band, decayed_weights
    from coloom.plans.sweeps import edge_counts

    v, ks = visits(spark, crowd), [0, 1, 3]
    gaps = brute(crowd, 3)
    want = {k: (len({a for (a, _), g in gaps.items() if g <= k}), sum(g <= k for g in gaps.values()) // 2) for k in ks}
    weights = {}
    for (a, _), g in gaps.items():
        weights[a] = weights.get(a, 0.0) + math.exp(-g / 5)
    kinds = set()
    for fanout in (2, 6, 12, 10**6):
        b = band(v, 3, fanout=fanout)
        kinds.add((b.crowds is not None, not b.arcs.isEmpty()))
        assert {r.k: (r.n_nodes, r.n_edges) for r in edge_counts(v, ks, fanout).collect()} == want
        got = {r.node: r.weight for r in decayed_weights(v, [5.0], 3, fanout=fanout).collect()}
        assert set(got) == set(weights) and all(abs(got[a] - w) < 1e-9 for a, w in weights.items())
    assert (False, True) in kinds and (True, False) in kinds
    assert [(r.k, r.n_nodes, r.n_edges) for r in edge_counts(v.limit(0), [1]).collect()] == [(1, 0, 0)]
