"""Repeating a model over windows, feature groups and seeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.operators.colocation import cluster_labels, members
from coloom.operators.features import without
from coloom.operators.metrics import long_metrics
from coloom.operators.models import evaluate
from coloom.operators.neighbors import FANOUT, band, neighbor_sums
from coloom.operators.split import hash_split
from coloom.session import cut

GROUPS = ["venue", "transport", "hotspot", "symptom", "age", "gender", "time", "event_count"]
WINDOWS = (1, 3, 5, 7, 14)
SEEDS = (42, 123, 456, 789, 1024)


def label_counts(cases: DataFrame, visits: DataFrame, ks: Sequence[int] = WINDOWS) -> DataFrame:
    """(k, positives, positive_ratio): every window from one pass over the visits."""
    labels = cluster_labels(visits, ks)
    every = cases.select("case_id").join(labels, "case_id", "left")
    picked = [
        F.struct(F.lit(k).alias("k"), F.coalesce(F.col(f"label_{k}"), F.lit(0)).alias("y")) for k in ks
    ]
    return (
        every.select(F.explode(F.array(*picked)).alias("x"))
        .groupBy(F.col("x.k").alias("k"))
        .agg(F.sum("x.y").cast("long").alias("positives"), F.avg("x.y").alias("positive_ratio"))
    )


def edge_counts(visits: DataFrame, ks: Sequence[int] = WINDOWS, fanout: int = FANOUT) -> DataFrame:
    """(k, n_nodes, n_edges) of the ±k day graph for each window; the visits are gone through once."""
    b = band(visits, max(ks), fanout=fanout)
    if b.crowds is None:
        within = F.explode(F.filter(F.lit(list(ks)), lambda k: k >= F.col("gap")))
        nodes = b.arcs.groupBy("src").agg(F.min("gap").alias("gap")).groupBy("gap").agg(F.count(F.lit(1)).alias("nodes"), F.lit(0).cast("long").alias("arcs"))
        arcs = b.arcs.groupBy("gap").agg(F.lit(0).cast("long").alias("nodes"), F.count(F.lit(1)).alias("arcs"))
        none = visits.sparkSession.createDataFrame([(k, 0, 0) for k in ks], "k int, nodes long, arcs long")
        every = nodes.unionByName(arcs).select(within.alias("k"), "nodes", "arcs").unionByName(none)
        return every.groupBy("k").agg(F.sum("nodes").alias("n_nodes"), (F.sum("arcs") / 2).cast("long").alias("n_edges"))
    return _collect(
        [
            neighbor_sums(members(b.crowds, k), fanout=fanout, more=b.arcs.where(F.col("gap") <= k).select("src", "dst")).agg(
                F.lit(k).alias("k"), F.count(F.lit(1)).alias("n_nodes"), F.coalesce((F.sum("degree") / 2).cast("long"), F.lit(0)).alias("n_edges")
            )
            for k in ks
        ]
    )


def training_table(features: DataFrame, labels: DataFrame, seed: int = 42) -> DataFrame:
    """(case_id, split, features..., label_<k>...) written out once for all fits."""
    names = [c for c in labels.columns if c != "case_id"]
    return cut(
        features.join(labels, "case_id", "left").na.fill(0, names).join(hash_split(features, seed=seed), "case_id")
    )


def _labelled(table: DataFrame, k: int) -> DataFrame:
    return table.withColumn("label", F.col(f"label_{k}"))


def _collect(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def window_sweep(table: DataFrame, cols: Sequence[str], ks: Sequence[int], model: str = "GBM", **kw) -> DataFrame:
    """Scores of the model for each label window."""
    return _collect(
        [
            evaluate(model, _labelled(table, k), cols, **kw).select(F.lit(k).alias("k"), "*")
            for k in ks
        ]
    )


def group_ablation(
    table: DataFrame, cols: Sequence[str], groups: Sequence[str], k: int = 3, model: str = "GBM", **kw
) -> DataFrame:
    """Scores with one feature group left out at a time; "full" keeps all."""
    data = _labelled(table, k)
    parts = [evaluate(model, data, cols, **kw).select(F.lit("full").alias("variant"), "*")]
    for g in groups:
        parts.append(evaluate(model, data, without(cols, g), **kw).select(F.lit(f"w/o {g}").alias("variant"), "*"))
    return _collect(parts)


def seed_sweep(
    features: DataFrame,
    labels: DataFrame,
    cols: Sequence[str],
    models: Sequence[str],
    k: int = 3,
    seeds: Sequence[int] = SEEDS,
    settings: dict | None = None,
) -> DataFrame:
    """(seed, model, metric, value): a new split and fit per seed."""
    parts = []
    for seed in seeds:
        data = _labelled(training_table(features, labels, seed), k)
        for m in models:
            one = evaluate(m, data, cols, seed, **(settings or {}).get(m, {}))
            parts.append(one.select(F.lit(seed).alias("seed"), F.lit(m).alias("model"), "*"))
    return long_metrics(_collect(parts), ["seed", "model"])
