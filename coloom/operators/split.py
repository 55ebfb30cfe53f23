"""Reproducible 70/10/20 split."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_split(
    df: DataFrame, key: str = "case_id", seed: int = 42, train: float = 0.7, validate: float = 0.1
) -> DataFrame:
    """(key, split): the rows in the order of md5(seed:key), cut at exact sizes."""
    seeded = df.select(key, F.lit(seed).alias("seed"))
    return hash_splits_by_seed(seeded, key, train, validate).select(key, "split")


def hash_splits_by_seed(df: DataFrame, key: str = "case_id", train: float = 0.7, validate: float = 0.1) -> DataFrame:
    """``df(key, seed, ..)`` with ``split``: the rows of each seed in the order of md5(seed:key), cut at exact sizes.

    The first four hex digits spread the rows evenly over 65,536 buckets; bucket
    counts give each bucket its offset, and rows are ordered inside their bucket.
    """
    text = F.concat_ws(":", F.col("seed").cast("string"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    hashed = df.withColumn("h", F.md5(text)).withColumn("bucket", F.substring("h", 1, 4))
    counts = hashed.groupBy("seed", "bucket").agg(F.count(F.lit(1)).alias("n"))
    # At most 65,536 rows for each seed.
    prior = Window.partitionBy("seed").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "seed",
        "bucket",
        F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("seed")).alias("total"),
    )
    inside = Window.partitionBy("seed", "bucket").orderBy("h", key)
    # As decimals: 0.7 as a double makes 62,999 of 90,000.
    n_train, n_val = (F.floor(F.col("total") * F.lit(Decimal(str(share)))) for share in (train, validate))
    return (
        hashed.join(F.broadcast(offsets), ["seed", "bucket"])
        .withColumn("pos", F.col("before") + F.row_number().over(inside))
        .withColumn(
            "split",
            F.when(F.col("pos") <= n_train, "train").when(F.col("pos") <= n_train + n_val, "val").otherwise("test"),
        )
        .drop("h", "bucket", "before", "total", "pos")
    )
