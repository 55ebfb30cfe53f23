"""Structure of the same-day network as a whole, per period and per week."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.functions import vocab
from coloom.operators.colocation import members, shared
from coloom.operators.components import member_components
from coloom.operators.neighbors import neighbor_sums
from coloom.session import cut


def slice_metrics(visits: DataFrame, slice_col: str, cases: DataFrame | None = None) -> DataFrame:
    """Network measures of every slice at once.

    One row per value of ``slice_col``: n_cases, n_edges, n_connected, density,
    avg_degree (over connected nodes), lcc_size, lcc_ratio.  ``cases(slice, case_id)``
    says who counts as present; by default everyone with a visit in the slice.
    """
    node = F.struct(F.col(slice_col).alias("slice"), F.col("case_id").alias("id"))
    m = members(visits, 0, ("province", "venue"), node).withColumn(
        "clique", F.struct(F.col("node.slice").alias("slice"), F.col("clique").alias("at"))
    )
    s = cut(shared(m))
    deg = neighbor_sums(s)
    per_slice = deg.groupBy(F.col("node.slice").alias(slice_col)).agg(
        F.sum("degree").alias("ends"), F.count(F.lit(1)).alias("n_connected")
    )
    largest = (
        member_components(s)
        .groupBy(F.col("node.slice").alias(slice_col), "component")
        .agg(F.count(F.lit(1)).alias("size"))
        .groupBy(slice_col)
        .agg(F.max("size").alias("lcc_size"))
    )
    present = (visits if cases is None else cases).select(slice_col, "case_id").distinct()
    sizes = present.groupBy(slice_col).agg(F.count(F.lit(1)).alias("n_cases"))
    joined = (
        sizes.join(per_slice, slice_col, "left")
        .join(largest, slice_col, "left")
        .na.fill(0, ["ends", "n_connected"])
        .withColumn("lcc_size", F.coalesce("lcc_size", F.lit(1).cast("long")))
    )
    n = F.col("n_cases")
    return joined.select(
        slice_col,
        "n_cases",
        (F.col("ends") / 2).cast("long").alias("n_edges"),
        "n_connected",
        (F.col("ends") / 2 / F.greatest(n * (n - 1) / 2, F.lit(1.0))).alias("density"),
        F.when(F.col("n_connected") > 0, F.col("ends") / F.col("n_connected")).otherwise(0.0).alias("avg_degree"),
        "lcc_size",
        (F.col("lcc_size") / n).alias("lcc_ratio"),
    )


def with_period(visits: DataFrame, cutover: dt.date) -> DataFrame:
    return visits.withColumn("period", F.when(F.col("day") < F.lit(cutover), "pre").otherwise("post"))


def pre_post_change(metrics: DataFrame, names=("density", "avg_degree", "lcc_ratio")) -> DataFrame:
    """(metric, pre, post, change_pct) from one row per period."""
    picked = [
        F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names
    ]
    long = metrics.select("period", F.explode(F.array(*picked)).alias("x")).select(
        "period", "x.metric", "x.value"
    )
    pre, post = (F.max(F.when(F.col("period") == p, F.col("value"))) for p in ("pre", "post"))
    return (
        long.groupBy("metric")
        .agg(F.coalesce(pre, F.lit(0.0)).alias("pre"), F.coalesce(post, F.lit(0.0)).alias("post"))
        .withColumn("change_pct", (F.col("post") - F.col("pre")) / (F.col("pre") + F.lit(1e-9)) * 100)
    )


def with_week(visits: DataFrame, first_day: dt.date, gap: int = 7) -> DataFrame:
    """Adds ``week_num``: gap-day buckets counted from ``first_day``."""
    return visits.withColumn(
        "week_num", F.floor(F.datediff(F.col("day"), F.lit(first_day)) / gap).cast("int")
    )


def day_span(visits: DataFrame) -> tuple[dt.date, dt.date]:
    return tuple(visits.agg(F.min("day"), F.max("day")).first())


def weekly_series(
    visits: DataFrame,
    events: DataFrame | None = None,
    cutover: dt.date = vocab.LOCKDOWN_DATE,
    festival: dt.date = vocab.FESTIVAL_DATE,
    gap: int = 7,
    fill: bool = True,
) -> DataFrame:
    """One row per week from the first event date, with network measures.

    ``events(case_id, day)`` are the dated events that count for n_events, n_cases
    and the calendar; visits are the ones with a place and default to the events.
    A week belongs to "post" by its first day.  ``fill=False`` leaves out weeks
    without an event.
    """
    events = visits if events is None else events
    first, last = day_span(events)
    weekly_events = with_week(events, first, gap)
    counts = weekly_events.groupBy("week_num").agg(F.count(F.lit(1)).alias("n_events"))
    m = slice_metrics(with_week(visits, first, gap), "week_num", weekly_events).join(counts, "week_num")
    if fill:
        weeks = (last - first).days // gap + 1
        spine = events.sparkSession.range(weeks).select(F.col("id").cast("int").alias("week_num"))
        m = spine.join(m, "week_num", "left").na.fill(0)
    start = F.date_add(F.lit(first), F.col("week_num") * gap)
    post = start >= F.lit(cutover)
    return m.select(
        start.alias("week_start"),
        "week_num",
        post.cast("int").alias("post"),
        (start >= F.lit(festival)).cast("int").alias("spring_festival"),
        F.when(post, F.floor(F.datediff(start, F.lit(cutover)) / gap)).otherwise(0).cast("int").alias("post_weeks"),
        "n_events",
        "n_cases",
        "n_edges",
        "density",
        "avg_degree",
        "lcc_ratio",
    )


def active_week_summary(series: DataFrame, names=("density", "n_edges", "avg_degree")) -> DataFrame:
    """(metric, pre_mean, post_mean, pct_change, n_pre, n_post) over weeks with an edge."""
    picked = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("y")) for n in names]
    long = series.where("n_edges > 0").select("post", F.explode(F.array(*picked)).alias("x"))
    side = lambda v: F.when(F.col("post") == v, F.col("x.y"))
    return (
        long.groupBy(F.col("x.metric").alias("metric"))
        .agg(
            F.coalesce(F.avg(side(0)), F.lit(0.0)).alias("pre_mean"),
            F.coalesce(F.avg(side(1)), F.lit(0.0)).alias("post_mean"),
            F.count(side(0)).alias("n_pre"),
            F.count(side(1)).alias("n_post"),
        )
        .withColumn(
            "pct_change",
            (F.col("post_mean") - F.col("pre_mean")) / (F.col("pre_mean") + F.lit(1e-9)) * 100,
        )
    )


def isolation(nodes: DataFrame, labels: DataFrame, label: str, group: str) -> DataFrame:
    """(group, n, isolated, rate): members without company.

    Having a neighbour is the same as a positive label, so no graph is built.
    """
    flag = F.when(F.coalesce(F.col(label), F.lit(0)) == 0, 1).otherwise(0)
    return (
        nodes.join(labels, "case_id", "left")
        .groupBy(group)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(flag).cast("long").alias("isolated"))
        .withColumn("rate", F.col("isolated") / F.col("n"))
    )


def isolation_overlap(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of cases isolated under label ``a``, under ``b``, both, or only one."""
    x, y = F.col(a) == 0, F.col(b) == 0
    tally = lambda cond: F.count(F.when(cond, 1))
    return labels.agg(
        tally(x).alias("isolated_a"),
        tally(y).alias("isolated_b"),
        tally(x & y).alias("both"),
        tally(x & ~y).alias("only_a"),
        tally(~x & y).alias("only_b"),
    )
