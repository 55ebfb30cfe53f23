"""Extraction and weekly counts over reports that keep arriving.

The extractors are plain column expressions, so a streaming frame of reports goes
through them unchanged; weekly counts are a tumbling window anchored at a given day.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.functions import vocab
from coloom.operators.extract import extract_events
from coloom.sources.reports import split_cases


def stream_events(reports: DataFrame, cutover: dt.date = vocab.LOCKDOWN_DATE) -> DataFrame:
    """Event rows of a streaming frame (province, content)."""
    return extract_events(split_cases(reports), cutover)


def weekly_counts(
    events: DataFrame, anchor: dt.date, date: str = "date", gap: int = 7, lateness: str = "30 days"
) -> DataFrame:
    """(week_start, n_events) per ``gap``-day window counted from ``anchor``.

    A window is closed once the watermark has passed it; later events are dropped.
    """
    offset = (anchor - dt.date(1970, 1, 1)).days % gap
    stamped = events.where(F.col(date).isNotNull()).withColumn("_at", F.col(date).cast("timestamp"))
    return (
        stamped.withWatermark("_at", lateness)
        .groupBy(F.window("_at", f"{gap} days", startTime=f"{offset} days").alias("w"))
        .agg(F.count(F.lit(1)).alias("n_events"))
        .select(F.to_date("w.start").alias("week_start"), "n_events")
    )
