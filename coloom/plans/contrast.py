"""How two groups of subjects differ in network position."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.operators.centrality import betweenness, local_rank, transitivity_share
from coloom.operators.colocation import members, shared
from coloom.operators.inference import cohens_d, mann_whitney
from coloom.session import cut


def case_positions(
    cases: DataFrame, visits: DataFrame, k: int = 6, paths: bool = True, n_nodes: int | None = None
) -> DataFrame:
    """(case_id, degree, local_rank, transitivity[, betweenness]), 0 for isolates.

    All of them use the whole ±k day graph.
    """
    nodes = cases.select(F.col("case_id").alias("node"))
    s = cut(shared(members(visits, k)))
    out = local_rank(s, nodes)
    closed = transitivity_share(s).select("node", F.col("share").alias("transitivity"))
    out = out.join(closed, "node", "left")
    if paths:
        total = nodes.count() if n_nodes is None else n_nodes
        out = out.join(betweenness(s, total), "node", "left")
    return out.na.fill(0).withColumnRenamed("node", "case_id")


def group_contrast(positions: DataFrame, cases: DataFrame, flag: str, metrics: list[str]) -> DataFrame:
    """(metric, means, stds, U, p, d): one row per metric."""
    rows = cut(positions.join(cases.select("case_id", flag), "case_id"))
    out = None
    for m in metrics:
        d = cohens_d(rows, flag, m).withColumn("metric", F.lit(m))
        u = mann_whitney(rows, flag, m).select(F.lit(m).alias("metric"), "u_stat", "z", "p_value")
        both = d.unionByName(u, allowMissingColumns=True)
        out = both if out is None else out.unionByName(both)
    # Two rows per metric, each with its own columns filled.
    return out.groupBy("metric").agg(*[F.max(c).alias(c) for c in out.columns if c != "metric"])
