"""Writing stage tables, graph bundles and the records exported as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def exists(spark: SparkSession, path: str) -> bool:
    """True when ``path`` holds a finished Spark output."""
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + "/_SUCCESS")
    return done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write parquet and return the table read back."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.parquet(path)


#: Records of one JSON file; a compressed file is read back by one task.
RECORDS = 1_000_000


def write_json(df: DataFrame, path: str) -> None:
    """Newline-delimited JSON, nulls kept, compressed: field names and words repeat in every record."""
    options = {"ignoreNullFields": "false", "compression": "gzip", "maxRecordsPerFile": RECORDS}
    df.write.mode("overwrite").options(**options).json(path)


GRAPH_PARTS = ("edges", "nodes", "case_features", "date_features", "labels", "splits")


def write_graph(parts: dict[str, DataFrame], path: str) -> None:
    """A graph bundle: one parquet folder per part, edges split by relation."""
    for name, df in parts.items():
        if name not in GRAPH_PARTS:
            raise ValueError(f"unknown graph part: {name}")
        write_table(
            df, f"{path}/{name}", ["src_type", "dst_type"] if name == "edges" else None
        )


def read_graph(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {
        name: spark.read.parquet(f"{path}/{name}")
        for name in GRAPH_PARTS
        if exists(spark, f"{path}/{name}")
    }
