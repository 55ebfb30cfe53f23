"""Column helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw(text: str) -> Column:
    """The UTF-8 bytes of a text column; a null text has none."""
    return F.coalesce(F.col(text).cast("binary"), F.expr("X''"))


def content_key(text: Column) -> list[Column]:
    """128 bits that stand for a whole text: equal texts, and in practice only those, share both."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def small_batches(batches: Iterator[pa.RecordBatch], most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches with about ``most`` bytes of ``column``, one row at least."""
    for batch in batches:
        sizes = batch.column(column).nbytes
        rows = max(1, int(batch.num_rows * most / max(sizes, 1)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
