"""Case blocks to case rows and event rows (narrow: no shuffle)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coloom.functions import text as X
from coloom.functions import vocab


def extract_cases(blocks: DataFrame) -> DataFrame:
    """One row per case block, with the first and last date by text position."""
    t = F.col("case_text")
    dated = blocks.withColumn("_dates", X.date_mentions(t))
    return dated.select(
        "case_id",
        "province",
        X.age(t).alias("age"),
        X.gender(t).alias("gender"),
        X.hotspot_flag(t).cast("int").alias("wuhan_related"),
        X.asymptomatic_flag(t).cast("int").alias("is_asymptomatic"),
        F.try_element_at("_dates", F.lit(1)).alias("first_date"),
        F.try_element_at("_dates", F.lit(-1)).alias("last_date"),
    )


def event_dates(text: Column) -> Column:
    """The date, or null, of every sentence that is an event, by the rule of ``extract_events``."""

    def read(x: Column) -> Column:
        named = (F.size(X.venue_types(x)) > 0) | (F.size(X.transport_codes(x)) > 0)
        return F.struct(F.try_element_at(X.date_mentions(x), F.lit(1)).alias("date"), named.alias("named"))

    found = F.filter(F.transform(X.sentences(text), read), lambda e: e["date"].isNotNull() | e["named"])
    return F.transform(found, lambda e: e["date"])


def extract_events(
    blocks: DataFrame, cutover: dt.date = vocab.LOCKDOWN_DATE, max_chars: int | None = None
) -> DataFrame:
    """One row per sentence with a date, a venue or a transport."""
    s = F.col("sentence")

    def read(x: Column) -> Column:
        return F.struct(
            x.alias("sentence"),
            F.try_element_at(X.date_mentions(x), F.lit(1)).alias("date"),
            X.venue_types(x).alias("venues"),
            X.transport_codes(x).alias("transports"),
        )

    # Read inside the array: a filter after the explode would be pushed below the
    # projection and evaluate every extractor twice.
    parts = F.filter(
        F.transform(X.sentences(F.col("case_text")), read),
        lambda e: e["date"].isNotNull() | (F.size(e["venues"]) > 0) | (F.size(e["transports"]) > 0),
    )
    found = (
        blocks.select("case_id", "province", F.explode_outer(parts).alias("e"))
        .where("e is not null")
        .select("case_id", "province", "e.*")
        .withColumn("event_type", X.event_type(s))
    )
    names = F.create_map(*[F.lit(v) for kv in vocab.EVENT_TYPES.items() for v in kv])
    return found.select(
        "case_id",
        "province",
        "event_type",
        names[F.col("event_type")].alias("event_type_name"),
        "date",
        "venues",
        "transports",
        X.symptom_terms(s).alias("symptoms"),
        X.prefix(s, max_chars).alias("sentence"),
        (F.col("date") >= F.lit(cutover)).alias("is_lockdown"),
    )


def extract_case_details(blocks: DataFrame, as_coded: bool = False, max_chars: int | None = None) -> DataFrame:
    """The statistics view of a case: whole-text vocabularies, min/max dates."""
    t = F.col("case_text")
    return blocks.withColumn("dates", X.all_dates(t, as_coded=as_coded)).select(
        "province",
        F.col("case_no").alias("case_id"),
        X.prefix(t, max_chars).alias("text"),
        "dates",
        F.array_min("dates").alias("first_date"),
        F.array_max("dates").alias("last_date"),
        X.venue_types(t, vocab.STAT_VENUES).alias("venues"),
        X.symptom_classes(t).alias("symptoms"),
        X.asymptomatic_flag(t).alias("is_asymptomatic"),
        X.hotspot_flag(t).alias("wuhan_connection"),
        X.age_statistics(t).alias("age"),
        X.gender(t, "男", "女").alias("gender"),
    )


def visits_of(events: DataFrame) -> DataFrame:
    """Dated visits (case_id, province, venue, day) of the events."""
    return events.where(F.col("date").isNotNull() & (F.size("venues") > 0)).select(
        "case_id", "province", F.explode("venues").alias("venue"), F.col("date").alias("day")
    )
