"""Views of a star schema as subjects, places and days.

``visits`` is the shape everything hangs off: (case_id, province, venue, day).
Orders give the subject, shipped lines the place (supplier) and the day,
the customer's nation the province.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coloom.functions import vocab
from coloom.session import size_shuffles

VENUE_CODES = list(vocab.VENUES)
TRANSPORT_CODES = sorted(set(vocab.TRANSPORTS.values()))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], index) -> F.Column:
    """``values[index]`` for a column index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped lines with their customer and nation.

    Nation has a fixed 25 rows, so it is broadcast; the sides of the other joins
    grow with the data and are left to the optimiser.  Shuffles of the session get
    partitions for their number (a count from the file footers).
    """
    shipped = table(spark, sf_dir, "lineitem")
    size_shuffles(spark, shipped.count())
    customers = (
        table(spark, sf_dir, "customer")
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        .select("c_custkey", "n_name")
    )
    return (
        shipped.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
    )


def ship_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, province, venue, day): one row per shipped line."""
    return lines(spark, sf_dir).select(
        F.col("c_custkey").alias("case_id"),
        F.col("n_name").alias("province"),
        F.col("l_suppkey").alias("venue"),
        F.to_date("l_shipdate").alias("day"),
    )


def quarter_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(case_id, province, venue, day): customers by market segment and quarter of their orders."""
    return (
        table(spark, sf_dir, "orders")
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.col("o_custkey").alias("case_id"),
            F.col("c_mktsegment").alias("province"),
            F.lit("all").alias("venue"),
            F.to_date(F.date_trunc("quarter", "o_orderdate")).alias("day"),
        )
    )


def ship_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects with attributes.  ``flagged`` marks the group RQ2 compares."""
    customers = table(spark, sf_dir, "customer").join(
        F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey")
    )
    key = F.col("c_custkey")
    return customers.select(
        key.alias("case_id"),
        F.col("n_name").alias("province"),
        F.when(key % 7 != 0, key % 90).cast("int").alias("age"),
        F.when(F.col("c_mktsegment") == "BUILDING", None)
        .when(F.col("c_mktsegment").isin("HOUSEHOLD", "MACHINERY"), "M")
        .otherwise("F")
        .alias("gender"),
        (F.col("c_nationkey") < 5).cast("int").alias("wuhan_related"),
        (F.col("c_acctbal") < 0).cast("int").alias("is_asymptomatic"),
    )


def ship_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with venue types, transports and symptoms, one per shipped line.

    Undated where the tax rate is 0.08, so null handling is exercised.
    """
    transport = _pick(TRANSPORT_CODES, F.col("l_partkey") % len(TRANSPORT_CODES))
    symptom = _pick(vocab.SYMPTOMS, F.col("l_orderkey") % len(vocab.SYMPTOMS))
    none = F.array().cast("array<string>")
    return lines(spark, sf_dir).select(
        F.col("c_custkey").alias("case_id"),
        F.col("n_name").alias("province"),
        (F.col("l_partkey") % 9 + 1).cast("int").alias("event_type"),
        F.when(F.col("l_tax") < 0.08, F.to_date("l_shipdate")).alias("date"),
        F.array(_pick(VENUE_CODES, F.col("l_suppkey") % len(VENUE_CODES))).alias("venues"),
        F.when(F.col("l_linenumber") % 2 == 1, F.array(transport)).otherwise(none).alias("transports"),
        F.when(F.col("l_returnflag") == "R", F.array(symptom)).otherwise(none).alias("symptoms"),
    )


def click_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as (case_id, venue, ts, day)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id"),
        F.col("user_id").alias("case_id"),
        F.col("event_type").alias("venue"),
        "ts",
        F.to_date("ts").alias("day"),
    )


def line_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case-report texts spelled out from shipped lines: (report_id, province, content).

    Each line becomes a report of two cases, with dates, ranges, venues,
    transports and symptoms taken from its columns.
    """
    venue_words = [words[0] for words in vocab.VENUES.values()]
    transport_words = list(vocab.TRANSPORTS)
    ship = F.to_date("l_shipdate")
    month, day = F.month(ship).cast("string"), F.dayofmonth(ship).cast("string")
    sex = F.when(F.col("l_returnflag") == "A", "男").when(F.col("l_returnflag") == "N", "女").otherwise("患者")
    age = F.col("l_quantity").cast("int").cast("string")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("report_id"),
        F.concat(F.lit("区域"), (F.col("l_suppkey") % 30).cast("string")).alias("province"),
        F.concat(
            F.lit("通报如下。第"),
            F.col("l_orderkey").cast("string"),
            F.lit("号确诊病例，"),
            sex,
            F.lit("，"),
            age,
            F.lit(" 岁。"),
            month,
            F.lit("月"),
            day,
            F.lit("日到"),
            _pick(venue_words, F.col("l_suppkey") % len(venue_words)),
            F.lit("；乘坐"),
            _pick(transport_words, F.col("l_partkey") % len(transport_words)),
            F.lit("前往"),
            F.when(F.col("l_linenumber") % 3 == 0, "武汉").otherwise("外地"),
            F.lit("。出现"),
            _pick(vocab.SYMPTOMS, F.col("l_orderkey") % len(vocab.SYMPTOMS)),
            F.lit("；好；第"),
            F.col("l_partkey").cast("string"),
            F.lit("号确诊病例，女，"),
            F.when(F.col("l_linestatus") == "O", "无症状").otherwise("咳嗽"),
            F.lit("。"),
            F.year(ship).cast("string"),
            F.lit("年"),
            month,
            F.lit("月"),
            day,
            F.lit("日至"),
            F.lit("28日在"),
            _pick(venue_words, F.col("l_partkey") % len(venue_words)),
            F.lit("，之后"),
        ).alias("content"),
    )
