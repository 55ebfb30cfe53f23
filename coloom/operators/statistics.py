"""Descriptive statistics of cases, events and visits."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coloom.functions import text as X
from coloom.functions import vocab
from coloom.operators.extract import event_dates


def frequency(df: DataFrame, col: str) -> DataFrame:
    """(col, n, share) in falling order; the total comes from the counts, not a second scan."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), col)


def array_frequency(df: DataFrame, col: str) -> DataFrame:
    """Frequency of the items of an array column."""
    return frequency(df.select(F.explode(col).alias("item")), "item")


def venue_frequency(visits: DataFrame) -> DataFrame:
    """(venue, n_events, n_cases).  Undated visits count.

    Cases are made distinct per venue first, so a busy venue is spread over tasks.
    """
    per_case = visits.groupBy("venue", "case_id").agg(F.count(F.lit(1)).alias("k"))
    return per_case.groupBy("venue").agg(
        F.sum("k").alias("n_events"), F.count(F.lit(1)).alias("n_cases")
    )


def extraction_stats(events: DataFrame, cases: DataFrame) -> DataFrame:
    """One row of totals over the extracted events and cases."""
    c = cases.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.sum((F.col("is_asymptomatic") == 1).cast("long")).alias("asymptomatic_count"),
    )
    e = events.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count("date").alias("dated_events"),
        F.count(F.when(~F.col("is_lockdown"), 1)).alias("pre_lockdown_events"),
        F.count(F.when(F.col("is_lockdown"), 1)).alias("post_lockdown_events"),
    )
    t = one_row(e, c)
    return t.select(
        "total_cases",
        "total_events",
        (F.col("total_events") / F.col("total_cases")).alias("avg_events_per_case"),
        "dated_events",
        (F.col("dated_events") / F.col("total_events") * 100).alias("dated_ratio"),
        "pre_lockdown_events",
        "post_lockdown_events",
        "asymptomatic_count",
    )


def block_stats(blocks: DataFrame) -> DataFrame:
    """One row of totals over the cases of ``blocks`` and their events.

    Events are counted inside each block's row, so the text is read once.
    """
    dates = F.transform(event_dates(F.col("case_text")), lambda d: F.struct(d.alias("day")))
    late = lambda d: d["day"] >= F.lit(vocab.LOCKDOWN_DATE)
    rows = blocks.select(dates.alias("dates"), X.asymptomatic_flag(F.col("case_text")).alias("flag"))
    each = rows.select(
        F.col("flag").cast("long").alias("flag"),
        F.size("dates").alias("n"),
        F.size(F.filter("dates", lambda d: d["day"].isNotNull())).alias("dated"),
        F.size(F.filter("dates", lambda d: ~late(d))).alias("pre"),
        F.size(F.filter("dates", late)).alias("post"),
    )
    t = each.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.sum("flag").alias("asymptomatic_count"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum("dated"), F.lit(0)).alias("dated_events"),
        F.coalesce(F.sum("pre"), F.lit(0)).alias("pre_lockdown_events"),
        F.coalesce(F.sum("post"), F.lit(0)).alias("post_lockdown_events"),
    )
    return t.select(
        "total_cases",
        "total_events",
        (F.col("total_events") / F.col("total_cases")).alias("avg_events_per_case"),
        "dated_events",
        (F.col("dated_events") / F.col("total_events") * 100).alias("dated_ratio"),
        "pre_lockdown_events",
        "post_lockdown_events",
        "asymptomatic_count",
    )


def one_row(*parts: DataFrame) -> DataFrame:
    """The columns of several one-row frames side by side."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return every.agg(*[F.max(c).alias(c) for c in every.columns])


def province_stats(details: DataFrame) -> DataFrame:
    """Per province: cases, date records, flags, first and last date.

    ``details`` has one row per case with a ``dates`` array, so counting dates by
    array size adds no fan-out.
    """
    return details.groupBy("province").agg(
        F.count(F.lit(1)).alias("case_count"),
        F.sum(F.size("dates")).cast("long").alias("date_count"),
        F.sum(F.col("is_asymptomatic").cast("long")).alias("asymptomatic"),
        F.sum(F.col("wuhan_connection").cast("long")).alias("wuhan_related"),
        F.min(F.array_min("dates")).alias("first_date"),
        F.max(F.array_max("dates")).alias("last_date"),
    )


def top_items(pairs: DataFrame, group: str, item: str, k: int = 5) -> DataFrame:
    """(group, item, n, rank): the k most frequent items of each group, ties by item."""
    counts = pairs.groupBy(group, item).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(group).orderBy(F.desc("n"), item)
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_map(top: DataFrame, group: str, item: str) -> DataFrame:
    """The ``top_items`` rows of a group as one map column (at most k entries)."""
    entries = F.array_sort(F.collect_list(F.struct("rank", item, "n")))
    return top.groupBy(group).agg(
        F.map_from_entries(F.transform(entries, lambda e: F.struct(e[item], e["n"]))).alias("top")
    )


def daily_counts(dates: DataFrame, cutover: dt.date = vocab.LOCKDOWN_DATE, col: str = "date") -> DataFrame:
    """(date, count, period) for every calendar day between the first and the last."""
    counts = dates.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("date")).agg(
        F.count(F.lit(1)).alias("count")
    )
    spine = counts.agg(F.min("date").alias("a"), F.max("date").alias("b")).where("a is not null").select(
        F.explode(F.sequence("a", "b", F.expr("interval 1 day"))).alias("date")
    )
    return spine.join(counts, "date", "left").select(
        "date",
        F.coalesce("count", F.lit(0).cast("long")).alias("count"),
        F.when(F.col("date") < F.lit(cutover), "pre").otherwise("post").alias("period"),
    )


def coverage(
    dates: DataFrame,
    cutover: dt.date = vocab.LOCKDOWN_DATE,
    col: str = "date",
    days_before: int = 7,
    days_after: int = 14,
) -> DataFrame:
    """One row: records before and after the cut-over and whether they suffice."""
    d, c = F.col(col), F.lit(cutover)
    t = dates.agg(
        F.min(d).alias("first_date"),
        F.max(d).alias("last_date"),
        F.count(F.when(d < c, 1)).alias("pre_records"),
        F.count(F.when(d >= c, 1)).alias("post_records"),
    )
    before, after = F.datediff(c, F.col("first_date")), F.datediff(F.col("last_date"), c)
    has_pre, has_post = F.col("pre_records") > 0, F.col("post_records") > 0
    verdict = (
        F.when(has_pre & has_post & (before >= days_before) & (after >= days_after), "SUFFICIENT")
        .when(has_pre & has_post, "LIMITED")
        .when(has_pre, "PRE_ONLY")
        .when(has_post, "POST_ONLY")
        .otherwise("UNKNOWN")
    )
    return t.select(
        "first_date",
        "last_date",
        F.datediff("last_date", "first_date").alias("days_span"),
        "pre_records",
        "post_records",
        verdict.alias("coverage"),
    )


def dataset_stats(details: DataFrame, cutover: dt.date = vocab.LOCKDOWN_DATE) -> DataFrame:
    """One row over all cases: counts, ratios, date range, coverage."""
    totals = details.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_distinct("province").alias("province_count"),
        F.sum(F.col("is_asymptomatic").cast("long")).alias("asymptomatic_count"),
        F.sum(F.col("wuhan_connection").cast("long")).alias("wuhan_connection_count"),
    )
    cover = coverage(details.select(F.explode("dates").alias("date")), cutover)
    asym, hot, n = F.col("asymptomatic_count"), F.col("wuhan_connection_count"), F.col("total_cases")
    return one_row(totals, cover).withColumns(
        {"asymptomatic_ratio": asym / n * 100, "wuhan_connection_ratio": hot / n * 100}
    )


def group_moments(df: DataFrame, group: str, col: str) -> DataFrame:
    """(group, n, mean, std) with the population standard deviation."""
    return df.groupBy(group).agg(
        F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_pop(col).alias("std")
    )
