"""Which kinds of place carry the most cluster risk."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coloom.operators.colocation import cluster_labels
from coloom.operators.features import VENUES
from coloom.operators.inference import anova
from coloom.operators.ranking import ranked

MIN_VISITORS = 5


def venue_province_counts(visits: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """(venue, province, n_cases, n_clustered): distinct visitors, dated or not."""
    return (
        visits.select("venue", "province", "case_id")
        .distinct()
        .join(labels.select("case_id", label), "case_id", "left")
        .groupBy("venue", "province")
        .agg(
            F.count(F.lit(1)).alias("n_cases"),
            F.sum(F.coalesce(F.col(label), F.lit(0))).cast("long").alias("n_clustered"),
        )
    )


def venue_province_rates(
    visits: DataFrame, k: int = 3, min_visitors: int = MIN_VISITORS, labels: DataFrame | None = None
) -> DataFrame:
    """(venue, province, n_cases, rate) where at least ``min_visitors`` cases went."""
    labels = cluster_labels(visits, [k]) if labels is None else labels
    counts = venue_province_counts(visits, labels, f"label_{k}")
    return counts.where(F.col("n_cases") >= min_visitors).select(
        "venue", "province", "n_cases", (F.col("n_clustered") / F.col("n_cases")).alias("rate")
    )


def venue_cluster_rate(visits: DataFrame, k: int = 3, labels: DataFrame | None = None) -> DataFrame:
    """(venue, n_cases, cluster_rate) over the distinct visitors of a venue."""
    labels = cluster_labels(visits, [k]) if labels is None else labels
    return (
        visits.select("venue", "case_id")
        .distinct()
        .join(labels, "case_id", "left")
        .groupBy("venue")
        .agg(
            F.count(F.lit(1)).alias("n_cases"),
            F.avg(F.coalesce(F.col(f"label_{k}"), F.lit(0))).alias("cluster_rate"),
        )
    )


def venue_risk(
    visits: DataFrame, k: int = 3, min_visitors: int = MIN_VISITORS, labels: DataFrame | None = None
) -> DataFrame:
    """(venue, avg_risk, cluster_rate, n_cases, n_provinces).

    ``avg_risk`` is the plain mean of the province rates, 0 where no province has
    enough visitors.  A case belongs to one province, so the visitors of a venue
    are the sum over its provinces.
    """
    labels = cluster_labels(visits, [k]) if labels is None else labels
    n, c = F.col("n_cases"), F.col("n_clustered")
    enough = n >= min_visitors
    return (
        venue_province_counts(visits, labels, f"label_{k}")
        .groupBy("venue")
        .agg(
            F.coalesce(F.avg(F.when(enough, c / n)), F.lit(0.0)).alias("avg_risk"),
            (F.sum(c) / F.sum(n)).alias("cluster_rate"),
            F.sum(n).alias("n_cases"),
            F.count(F.when(enough, 1)).alias("n_provinces"),
        )
    )


def venue_risk_ranking(visits: DataFrame, importance: DataFrame | None = None, **kw) -> DataFrame:
    """``venue_risk`` with a 1-based rank, highest risk first, ties by venue.

    ``importance(name, importance)`` adds the score filed under ``venue_<venue>``, or
    under ``venue_<i>``, the feature column of the i-th venue of the vocabulary.
    """
    out = ranked(venue_risk(visits, **kw), [F.desc("avg_risk"), F.col("venue")])
    if importance is not None:
        filed = F.regexp_extract("name", "^venue_(.*)$", 1)
        by_column = F.create_map(*[F.lit(x) for i, v in enumerate(VENUES) for x in (str(i), v)])
        score = importance.select(
            F.coalesce(F.try_element_at(by_column, filed), filed).alias("venue"), F.col("importance").alias("feature_importance")
        )
        out = out.withColumn("venue", F.col("venue").cast("string")).join(score, "venue", "left").na.fill(
            0.0, ["feature_importance"]
        )
    return out


def venue_anova(visits: DataFrame, k: int = 3, min_visitors: int = MIN_VISITORS, min_provinces: int = 3) -> DataFrame:
    """Do the province rates differ between venues?"""
    return anova(venue_province_rates(visits, k, min_visitors), "venue", "rate", min_provinces)


def risk_rollup(visits: DataFrame, k: int = 3, labels: DataFrame | None = None, precision: int = 12) -> DataFrame:
    """(venue, province, level, n_cases, rate, cases_estimate): rates by venue and province, by venue, and over all.

    ``level`` is Spark's grouping id: 0 both, 1 venue alone, 3 all.  A case that was in several
    provinces or venues counts once at each level.  ``cases_estimate`` is the same count from
    sketches of the cells that are merged upwards; its relative standard error is
    1.04 / sqrt(2^precision), 1.6 % for 12.  Where counts may be estimated, the cells' sketches
    are all that has to be kept.
    """
    labels = cluster_labels(visits, [k]) if labels is None else labels
    hit = F.coalesce(F.col(f"label_{k}"), F.lit(0))
    rows = visits.select("venue", "province", "case_id").distinct().join(labels, "case_id", "left").select("venue", "province", "case_id", hit.alias("hit"))
    exact = rows.rollup("venue", "province").agg(
        F.grouping_id().cast("int").alias("level"),
        F.count_distinct("case_id").alias("n_cases"),
        (F.count_distinct(F.when(F.col("hit") == 1, F.col("case_id"))) / F.count_distinct("case_id")).alias("rate"),
    )
    cells = rows.groupBy("venue", "province").agg(F.hll_sketch_agg("case_id", F.lit(precision)).alias("sketch"))
    merged = cells.rollup("venue", "province").agg(
        F.grouping_id().cast("int").alias("level"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("cases_estimate")
    )
    same = [exact[c].eqNullSafe(merged[c]) for c in ("venue", "province", "level")]
    return exact.join(merged, same).select(*[exact[c] for c in exact.columns], "cases_estimate")
