"""Ranks and running totals over a whole table without a one-task window.

A window without a partition puts every row into one task.  Here the rows are
spread over ordered buckets, bucket totals (a bounded number of rows) are summed
up, and a window inside each bucket does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coloom.session import cut

BUCKETS = 256


def running_totals(
    df: DataFrame, key: str, sums: Sequence[str], buckets: int = BUCKETS
) -> DataFrame:
    """Adds ``before_<s>`` and ``total_<s>``: each sum over all smaller keys and over all.

    ``df`` has one row per key (group first).  Bucket borders are percentiles of
    the key, so buckets hold about equally many rows whatever the distribution.
    """
    steps = F.lit([i / buckets for i in range(1, buckets)])
    borders = df.agg(F.percentile_approx(F.col(key).cast("double"), steps, 10000).alias("b")).scalar()
    slotted = df.withColumn("_borders", borders).withColumn(
        "_slot", F.size(F.filter("_borders", lambda b: b < F.col(key).cast("double")))
    )
    slotted = slotted.drop("_borders")
    totals = slotted.groupBy("_slot").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    # At most ``buckets`` rows from here to the join.
    prior = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = totals.select(
        "_slot",
        *[F.coalesce(F.sum(f"_t_{s}").over(prior), F.lit(0)).alias(f"_o_{s}") for s in sums],
        *[F.sum(f"_t_{s}").over(every).alias(f"total_{s}") for s in sums],
    )
    inside = Window.partitionBy("_slot").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return (
        slotted.join(F.broadcast(offsets), "_slot")
        .withColumns(
            {
                f"before_{s}": F.col(f"_o_{s}") + F.coalesce(F.sum(s).over(inside), F.lit(0))
                for s in sums
            }
        )
        .drop("_slot", *[f"_o_{s}" for s in sums])
    )


def ranked(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds the 1-based position of every row in the total order ``order``.

    Rows are range-partitioned by the order and written out, so partition numbers
    stay fixed; one count per partition gives the offsets.
    """
    placed = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    prior = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(prior), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .drop("_part", "_before")
    )


def average_ranks(df: DataFrame, col: str, count: str = "n") -> DataFrame:
    """(value, ties, avg_rank) of ``df(value, n)``: tied values share their mean rank."""
    return running_totals(df, col, [count]).withColumn(
        "avg_rank", F.col(f"before_{count}") + (F.col(count) + 1) / 2
    )
