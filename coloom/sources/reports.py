"""Reading case-report files and the JSON records made from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coloom.functions import text as X
from coloom.functions import vocab

CASES = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("province", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("gender", T.StringType()),
        T.StructField("wuhan_related", T.IntegerType()),
        T.StructField("is_asymptomatic", T.IntegerType()),
        T.StructField("first_date", T.DateType()),
        T.StructField("last_date", T.DateType()),
    ]
)
EVENTS = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("province", T.StringType()),
        T.StructField("event_type", T.IntegerType()),
        T.StructField("event_type_name", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("venues", T.ArrayType(T.StringType())),
        T.StructField("transports", T.ArrayType(T.StringType())),
        T.StructField("symptoms", T.ArrayType(T.StringType())),
        T.StructField("sentence", T.StringType()),
        T.StructField("is_lockdown", T.BooleanType()),
    ]
)
DAILY_COUNTS = T.StructType(
    [
        T.StructField("date", T.DateType()),
        T.StructField("count", T.LongType()),
        T.StructField("period", T.StringType()),
    ]
)


def province_of(path: Column) -> Column:
    """File stem without the report suffix."""
    plain = F.coalesce(F.try_url_decode(F.regexp_replace(path, r"\+", "%2B")), path)
    stem = F.regexp_extract(plain, r"([^/]+?)(\.txt)?$", 1)
    return F.regexp_replace(stem, vocab.REPORT_SUFFIX, "")


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ``.txt`` file: (path, province, content).

    For files that fit a row.  ``read_case_blocks`` has no such limit.
    """
    return (
        spark.read.option("pathGlobFilter", "*.txt")
        .text(folder, wholetext=True)
        .select(F.input_file_name().alias("path"), F.col("value").alias("content"))
        .select("path", province_of(F.col("path")).alias("province"), "content")
    )


def split_cases(
    reports: DataFrame, content: str = "content", marker: str = vocab.CASE_MARKER
) -> DataFrame:
    """Explode each report into its case blocks; text before the first marker is dropped.

    Adds ``case_seq`` (position in the report), ``case_no``, ``case_id`` and
    ``case_text``; a block runs up to the next marker.
    """
    blocks = F.filter(F.split(content, f"(?={marker})"), lambda b: b.rlike(f"^{marker}"))
    keep = [c for c in reports.columns if c != content]
    # The outer form spares a second evaluation of the array in an inferred filter.
    rows = spread(reports).select(*keep, F.posexplode_outer(blocks).alias("case_seq", "case_text"))
    rows = rows.where("case_text is not null").withColumn("case_no", X.case_number(F.col("case_text")))
    return rows.select(
        *keep, "case_seq", "case_no", case_key(F.col("province"), F.col("case_no")).alias("case_id"), "case_text"
    )


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input with fewer splits than cores.

    Text work is bound by the processor.  Inputs of any size have more splits than
    the cluster has cores and are left as they are.
    """
    if df.isStreaming:
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Text (characters) and rows that a batch of cases holds, about.
CHUNK, BATCH = 1 << 22, 10_000


def case_key(province: Column, number: Column) -> Column:
    return F.concat(X.prefix(province, 2), F.lit("_"), number)


def read_case_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Case blocks of a folder of reports of any size.

    The first character of the marker is the record separator, so one large
    report is read as many splits.  Markers are counted for each split and summed up along a
    file (one row per split, broadcast); pieces of a case are put together where they are read, and
    only the two cases at the borders of a split are shuffled.  No task sees a whole file.
    """
    head, tail = vocab.CASE_MARKER[0], vocab.CASE_MARKER[1:]
    pieces = (
        spark.read.option("pathGlobFilter", "*.txt")
        .option("lineSep", head)
        .text(folder)
        .select(
            F.input_file_name().alias("path"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("pos"),
            F.col("value").rlike(f"^{tail}").alias("marked"),
            F.col("value").alias("piece"),
        )
    )
    # Nothing stands before the first piece of a file, so it starts no case.
    opens = F.when((F.col("split") == 0) & F.min_by("marked", "pos"), 1).otherwise(0)
    along = Window.partitionBy("path").orderBy("split")
    counts = (
        pieces.groupBy("path", "split")
        .agg((F.sum(F.col("marked").cast("long")) - opens).alias("n"))
        .select("path", "split", "n", (F.sum("n").over(along) - F.col("n")).alias("before"))
    )
    parts = (
        pieces.select("path", "split", "marked", "piece")
        .mapInArrow(_cases_of_splits(head), "path string, split long, local long, text string")
        .join(F.broadcast(counts), ["path", "split"])
        .where("before + local > 0")
        .withColumn("case_seq", F.col("before") + F.col("local") - 1)
    )
    border = (F.col("local") == 0) | (F.col("local") == F.col("n"))
    crossing = (
        parts.where(border)
        .groupBy("path", "case_seq")
        .agg(F.array_sort(F.collect_list(F.struct("split", "text"))).alias("parts"))
        .select("path", "case_seq", F.array_join(F.transform("parts", lambda p: p["text"]), head).alias("text"))
    )
    whole = (
        parts.where(~border).select("path", "case_seq", "text").unionByName(crossing)
        .select(
            "path",
            province_of(F.col("path")).alias("province"),
            F.col("case_seq").cast("int").alias("case_seq"),
            F.concat(F.lit(head), "text").alias("case_text"),
        )
    )
    number = X.case_number(F.col("case_text"))
    return whole.select(
        "path",
        "province",
        "case_seq",
        number.alias("case_no"),
        case_key(F.col("province"), number).alias("case_id"),
        "case_text",
    )


def _cases_of_splits(head: str):
    """A step over (path, split, marked, piece) in the order of the text: (path, split, local, text).

    ``local`` counts the cases that start in the split; 0 is the text before the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("path", "split", "local", "text")
        done, held, chars = [], [], 0
        at, local = None, 0
        for batch in batches:
            for path, split, marked, piece in zip(*(batch.column(c).to_pylist() for c in ("path", "split", "marked", "piece"))):
                same = (path, split) == at
                # The first piece of a file starts no case.
                marked = marked and (same or split > 0)
                if held and (marked or not same):
                    done.append((*at, local, head.join(held)))
                    held = []
                    if len(done) >= BATCH or chars >= CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)
                        done, chars = [], 0
                if not same:
                    at, local = (path, split), 0
                local += marked
                held.append(piece)
                chars += len(piece)
        if held:
            done.append((*at, local, head.join(held)))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names)

    return run


def _records(spark: SparkSession, path: str, schema: T.StructType, array: bool) -> DataFrame:
    """JSON records, one per line; ``array=True`` reads files that are one array, each in one task."""
    return spark.read.schema(schema).json(path, multiLine=array)


def read_cases(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    return _records(spark, path, CASES, array)


def read_events(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    return _records(spark, path, EVENTS, array)


def read_daily_counts(spark: SparkSession, path: str, array: bool = False) -> DataFrame:
    return _records(spark, path, DAILY_COUNTS, array)
