"""Case features: named, non-overlapping columns."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.functions import vocab

BASE = [
    "age_norm",
    "is_male",
    "is_female",
    "wuhan_related",
    "is_asymptomatic",
    "first_day_norm",
    "duration_norm",
    "event_count_norm",
]
SYMPTOM = ["has_symptom", "symptom_count_norm"]
ROW_STATS = ["venue_total", "venue_max", "venue_std", "venue_diversity", "transport_mean"]
VENUES = list(vocab.VENUES)
TRANSPORTS = sorted(set(vocab.TRANSPORTS.values()))


def venue_columns(venues: Sequence[str] = VENUES) -> list[str]:
    return [f"venue_{i}" for i in range(len(venues))]


def transport_columns(transports: Sequence[str] = TRANSPORTS) -> list[str]:
    return [f"transport_{t}" for t in transports]


def case_features(
    cases: DataFrame,
    events: DataFrame,
    cutover: dt.date = vocab.LOCKDOWN_DATE,
    venues: Sequence[str] = VENUES,
    transports: Sequence[str] = TRANSPORTS,
    symptoms: bool = True,
) -> DataFrame:
    """(case_id, base 8, one per venue, one per transport, symptom 2).

    Events are aggregated once per case, with one conditional count per venue and
    transport, and left-joined to the cases.  ``symptoms=False`` is the smaller
    layout without the last two.
    """
    has = lambda col, item: F.count(F.when(F.array_contains(col, item), 1))
    per_case = events.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_events"),
        *[has("venues", v).alias(f"v{i}") for i, v in enumerate(venues)],
        *[has("transports", t).alias(f"t{i}") for i, t in enumerate(transports)],
    )
    if symptoms:
        distinct = events.select("case_id", F.explode("symptoms").alias("s")).distinct()
        per_case = per_case.join(
            distinct.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_symptoms")), "case_id", "left"
        )
    span = cases.agg(F.min("age").alias("lo"), F.max("age").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    clip = lambda c, k: F.least(F.coalesce(F.col(c), F.lit(0)), F.lit(k)) / k
    zero = lambda e: F.coalesce(e, F.lit(0.0))
    columns = [
        zero((F.col("age") - lo) / (hi - lo + F.lit(1e-6))).alias("age_norm"),
        zero((F.col("gender") == "M").cast("double")).alias("is_male"),
        zero((F.col("gender") == "F").cast("double")).alias("is_female"),
        F.col("wuhan_related").cast("double").alias("wuhan_related"),
        F.col("is_asymptomatic").cast("double").alias("is_asymptomatic"),
        zero(F.datediff("first_date", F.lit(cutover)) / 100.0).alias("first_day_norm"),
        zero(F.datediff("last_date", "first_date") / 30.0).alias("duration_norm"),
        clip("n_events", 20).alias("event_count_norm"),
        *[clip(f"v{i}", 10).alias(c) for i, c in enumerate(venue_columns(venues))],
        *[clip(f"t{i}", 5).alias(c) for i, c in enumerate(transport_columns(transports))],
    ]
    if symptoms:
        columns += [
            F.when(F.coalesce(F.col("n_symptoms"), F.lit(0)) > 0, 1.0).otherwise(0.0).alias("has_symptom"),
            clip("n_symptoms", 5).alias("symptom_count_norm"),
        ]
    return cases.join(per_case, "case_id", "left").select("case_id", *columns)


def with_dates(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Adds the first and last event date of each case."""
    span = events.groupBy("case_id").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    return cases.join(span, "case_id", "left")


def row_stats(
    features: DataFrame,
    venues: Sequence[str] | None = None,
    transports: Sequence[str] | None = None,
) -> DataFrame:
    """Adds sum, max, population std and non-zero count of the venue columns, and the
    mean of the transport columns."""
    v = venues or venue_columns()
    t = transports or transport_columns()
    total = sum((F.col(c) for c in v[1:]), F.col(v[0]))
    mean = total / len(v)
    spread = sum(((F.col(c) - mean) * (F.col(c) - mean) for c in v[1:]), (F.col(v[0]) - mean) * (F.col(v[0]) - mean))
    return features.withColumns(
        {
            "venue_total": total,
            "venue_max": F.greatest(*v),
            "venue_std": F.sqrt(spread / len(v)),
            "venue_diversity": sum(((F.col(c) > 0).cast("double") for c in v[1:]), (F.col(v[0]) > 0).cast("double")),
            "transport_mean": sum((F.col(c) for c in t[1:]), F.col(t[0])) / len(t),
        }
    )


def feature_groups(venues: Sequence[str] | None = None, transports: Sequence[str] | None = None) -> dict[str, list[str]]:
    """Columns by what they stand for; ablation drops whole groups."""
    return {
        "age": ["age_norm"],
        "gender": ["is_male", "is_female"],
        "hotspot": ["wuhan_related"],
        "asymptomatic": ["is_asymptomatic"],
        "time": ["first_day_norm", "duration_norm"],
        "event_count": ["event_count_norm"],
        "venue": list(venues or venue_columns()) + ["venue_total", "venue_max", "venue_std", "venue_diversity"],
        "transport": list(transports or transport_columns()) + ["transport_mean"],
        "symptom": list(SYMPTOM),
    }


def without(columns: Sequence[str], *groups: str) -> list[str]:
    gone = {c for g in groups for c in feature_groups()[g]}
    return [c for c in columns if c not in gone]


def date_features(dates: DataFrame, cutover: dt.date = vocab.LOCKDOWN_DATE) -> DataFrame:
    """(date, days_norm, dow_sin, dow_cos, bias) of the distinct dates; Monday is 0."""
    angle = F.weekday("date") * F.lit(2 * math.pi / 7)
    return dates.select("date").where("date is not null").distinct().select(
        "date",
        (F.datediff("date", F.lit(cutover)) / 100.0).alias("days_norm"),
        F.sin(angle).alias("dow_sin"),
        F.cos(angle).alias("dow_cos"),
        F.lit(1.0).alias("bias"),
    )
