"""Scores of a binary classifier as DataFrame aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coloom.operators.ranking import running_totals

METRICS = ["AUC-ROC", "AP", "Accuracy", "F1", "Precision", "Recall"]


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def classification_metrics(
    df: DataFrame, score: str = "score", label: str = "label", threshold: float = 0.5
) -> DataFrame:
    """One row: AUC-ROC, AP, Accuracy, F1, Precision, Recall.

    Rows are first grouped by score, so ties are handled exactly: AUC gives a tied
    pair half a point and AP steps once per distinct score.  A ratio with an empty
    denominator is 0.
    """
    y = F.col(label).cast("long")
    per_score = df.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum(y).alias("pos"), F.sum(1 - y).alias("neg")
    )
    run = running_totals(per_score, "s", ["pos", "neg"])
    run = run.withColumns(
        {
            # positives and negatives with a score of at least s
            "tp": F.col("total_pos") - F.col("before_pos"),
            "fp": F.col("total_neg") - F.col("before_neg"),
        }
    )
    hit = F.col("s") >= threshold
    sums = run.agg(
        F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("auc"),
        F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"),
        F.coalesce(F.sum(F.when(hit, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(hit, F.col("neg"))), F.lit(0)).alias("fp"),
        F.sum("pos").alias("p"),
        F.sum("neg").alias("n"),
    )
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "p", "n"))
    return sums.select(
        F.when((p > 0) & (n > 0), F.col("auc") / p / n).alias("AUC-ROC"),
        _ratio(F.col("ap"), p).alias("AP"),
        ((tp + n - fp) / (p + n)).alias("Accuracy"),
        _ratio(2 * tp, tp + fp + p).alias("F1"),
        _ratio(tp, tp + fp).alias("Precision"),
        _ratio(tp, p).alias("Recall"),
    )


def precision_at_k(
    df: DataFrame, k: int = 20, score: str = "score", label: str = "label", key: str = "id"
) -> DataFrame:
    """One row: mean label of the k highest scores, ties by key (all rows if fewer)."""
    return (
        df.orderBy(F.desc(score), key)
        .limit(k)
        .agg(F.avg(F.col(label).cast("double")).alias(f"P@{k}"))
    )


def long_metrics(wide: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys..., metric, value) from one metric per column."""
    names = [c for c in wide.columns if c not in keys]
    picked = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return wide.select(*keys, F.explode(F.array(*picked)).alias("x")).select(*keys, "x.metric", "x.value")


def seed_summary(results: DataFrame) -> DataFrame:
    """(model, metric, mean, std) over the seeds of ``results(seed, model, metric, value)``."""
    return results.groupBy("model", "metric").agg(
        F.avg("value").alias("mean"), F.stddev_pop("value").alias("std")
    )


def paired_by_seed(results: DataFrame, a: str, b: str, metric: str) -> DataFrame:
    """(seed, a, b, delta): one metric of two models, matched by seed."""
    pick = lambda m: F.max(F.when(F.col("model") == m, F.col("value")))
    return (
        results.where((F.col("metric") == metric) & F.col("model").isin(a, b))
        .groupBy("seed")
        .agg(pick(a).alias("a"), pick(b).alias("b"))
        .where("a is not null and b is not null")
        .withColumn("delta", F.col("a") - F.col("b"))
    )


def delta_to_baseline(results: DataFrame, baseline: str, metrics: Sequence[str] = METRICS) -> DataFrame:
    """Adds ``d_<metric>``: the signed difference to the baseline variant.

    One row per variant, so the baseline is one value per window.
    """
    every = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    of = lambda m: F.max(F.when(F.col("variant") == baseline, F.col(f"`{m}`"))).over(every)
    return results.withColumns({f"d_{m}": F.col(f"`{m}`") - of(m) for m in metrics})
