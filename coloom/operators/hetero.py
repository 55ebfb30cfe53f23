"""The heterogeneous graph: cases linked to venues, dates, transports, symptoms, cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.functions import vocab
from coloom.operators.colocation import members, pairs, shared
from coloom.operators.ranking import ranked

# Nodes of other kinds than cases that go out to all tasks.
FEW = 1 << 16


def item_edges(
    events: DataFrame,
    cases: DataFrame,
    venues: Sequence[str] = tuple(vocab.VENUES),
    symptoms: Sequence[str] = tuple(vocab.GRAPH_SYMPTOMS),
) -> DataFrame:
    """(src_type, dst_type, case_id, item, weight): one row per event and item.

    One scan of the events: the items of an event become one array of (type, name)
    and are exploded together.  Events of unknown cases are dropped.
    """
    tag = lambda kind, arr: F.transform(
        arr, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item"))
    )
    known = lambda col, names: F.filter(F.col(col), lambda x: x.isin(list(names)))
    dates = F.array_compact(F.array(F.col("date").cast("string")))
    items = F.concat(
        tag("venue", known("venues", venues)),
        tag("date", dates),
        tag("transport", F.col("transports")),
        tag("symptom", known("symptoms", symptoms)),
    )
    return (
        events.join(cases.select("case_id").distinct(), "case_id", "left_semi")
        .select("case_id", F.explode(items).alias("x"))
        .select(
            F.lit("case").alias("src_type"),
            F.col("x.kind").alias("dst_type"),
            "case_id",
            F.col("x.item").alias("item"),
            F.lit(1.0).alias("weight"),
        )
    )


def case_edges(visits: DataFrame, multigraph: bool = True) -> DataFrame:
    """(src_type, dst_type, case_id, item, weight): same place, same day.

    ``multigraph=True`` keeps one edge per shared group.
    """
    return pairs(members(visits, 0), multigraph).select(
        F.lit("case").alias("src_type"),
        F.lit("case").alias("dst_type"),
        F.col("src").alias("case_id"),
        F.col("dst").cast("string").alias("item"),
        F.lit(1.0).alias("weight"),
    )


def case_edge_count(visits: DataFrame) -> DataFrame:
    """(src_type, dst_type, n_edges) of ``case_edges``, from the group sizes alone."""
    sizes = shared(members(visits, 0)).groupBy("clique").agg(F.first("n").alias("n"))
    return sizes.agg(F.coalesce(F.sum(F.expr("n * (n - 1) div 2")), F.lit(0)).cast("long").alias("n_edges")).select(
        F.lit("case").alias("src_type"), F.lit("case").alias("dst_type"), "n_edges"
    )


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src_type", "dst_type").agg(F.count(F.lit(1)).alias("n_edges"))


def node_map(
    events: DataFrame,
    cases: DataFrame,
    venues: Sequence[str] = tuple(vocab.VENUES),
    symptoms: Sequence[str] = tuple(vocab.GRAPH_SYMPTOMS),
) -> DataFrame:
    """(node_type, name, idx): ids from 0 within each type.

    Venues and symptoms keep the order of their vocabulary; cases, dates and
    transports are numbered in sorted order, so ids do not depend on the run.
    """
    spark = events.sparkSession
    fixed = [("venue", v, i) for i, v in enumerate(venues)] + [("symptom", s, i) for i, s in enumerate(symptoms)]
    small = spark.createDataFrame(fixed, "node_type string, name string, idx long")
    named = (
        cases.select(F.lit("case").alias("node_type"), F.col("case_id").cast("string").alias("name"))
        .unionByName(
            events.where("date is not null").select(
                F.lit("date").alias("node_type"), F.col("date").cast("string").alias("name")
            )
        )
        .unionByName(
            events.select(F.lit("transport").alias("node_type"), F.explode("transports").alias("name"))
        )
        .distinct()
    )
    placed = ranked(named, [F.col("node_type"), F.col("name")], "pos")
    first = placed.groupBy("node_type").agg(F.min("pos").alias("first"))
    numbered = placed.join(F.broadcast(first), "node_type").select(
        "node_type", "name", (F.col("pos") - F.col("first")).cast("long").alias("idx")
    )
    return small.unionByName(numbered)


def indexed_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src_type, dst_type, src, dst, weight) with node ids.

    Edges keep their place: cases are joined by the id that edges are dealt by, not by its
    text, and the ids of venues, transports, symptoms and dates go out to all tasks where
    they are counted to be at most ``FEW``.  Nothing bounds them, so more are left to the optimiser.
    """
    own = edges.schema["case_id"].dataType
    case = nodes.where("node_type = 'case'").select(F.col("name").alias("case_name"), F.col("idx").alias("src"))
    dims = nodes.where("node_type <> 'case'").select(
        F.col("node_type").alias("dst_type"), F.col("name").alias("item"), F.col("idx").alias("dst")
    )
    if dims.limit(FEW + 1).count() <= FEW:
        dims = F.broadcast(dims)
    other = case.withColumnsRenamed({"case_name": "item", "src": "dst"})
    with_src = edges.join(case.select(F.col("case_name").cast(own).alias("case_id"), "src"), "case_id")
    columns = ["src_type", "dst_type", "src", "dst", "weight"]
    return (
        with_src.where("dst_type <> 'case'")
        .join(dims, ["dst_type", "item"])
        .select(columns)
        .unionByName(with_src.where("dst_type = 'case'").join(other, "item").select(columns))
    )


def label_distribution(labels: DataFrame, label: str) -> DataFrame:
    return labels.agg(
        F.sum(F.col(label)).cast("long").alias("positive"),
        F.sum(1 - F.col(label)).cast("long").alias("negative"),
        F.avg(F.col(label)).alias("positive_ratio"),
    )
