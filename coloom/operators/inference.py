"""Statistical tests.

Spark aggregates the data to a few sums; the formulas are column expressions over
those.  Only the solution of a k x k normal system (k <= 7) is numpy, inside a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coloom.functions.distributions import f_upper, normal_upper, stars, t_two_sided
from coloom.operators.ranking import average_ranks
from coloom.session import cut


def anova(df: DataFrame, group: str, value: str, min_size: int = 3) -> DataFrame:
    """One row: one-way analysis of variance over groups of ``min_size`` or more values."""
    g = df.groupBy(group).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var")
    ).where(F.col("n") >= min_size)
    t = g.agg(
        F.count(F.lit(1)).alias("groups"),
        F.sum("n").alias("total"),
        F.sum(F.col("n") * F.col("var")).alias("ss_within"),
        F.sum(F.col("n") * F.col("mean") * F.col("mean")).alias("sq"),
        F.sum(F.col("n") * F.col("mean")).alias("lin"),
    )
    ssb = F.col("sq") - F.col("lin") * F.col("lin") / F.col("total")
    t = t.select(
        "groups",
        "total",
        ssb.alias("ss_between"),
        "ss_within",
        (F.col("groups") - 1).alias("df_between"),
        (F.col("total") - F.col("groups")).alias("df_within"),
    )
    f = F.when(
        (F.col("df_between") > 0) & (F.col("df_within") > 0) & (F.col("ss_within") > 0),
        (F.col("ss_between") / F.col("df_between")) / (F.col("ss_within") / F.col("df_within")),
    )
    return t.withColumn("f_stat", f).withColumn(
        "p_value", f_upper(F.col("f_stat"), F.col("df_between"), F.col("df_within"))
    )


def mann_whitney(df: DataFrame, flag: str, value: str) -> DataFrame:
    """One row: two-sided Mann-Whitney U of the rows with flag 1 against flag 0.

    Values are grouped first, so ranks are taken over the distinct values.  The
    normal approximation has tie and continuity corrections.
    """
    y = F.col(flag).cast("long")
    per_value = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(y).alias("n_a")
    )
    s = average_ranks(per_value, "v").agg(
        F.sum("n_a").alias("n1"),
        F.sum(F.col("n") - F.col("n_a")).alias("n0"),
        F.sum(F.col("n_a") * F.col("avg_rank")).alias("r1"),
        F.sum(F.col("n").cast("double") * F.col("n") * F.col("n") - F.col("n")).alias("ties"),
    )
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    n = n1 + n0
    u = F.col("r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    out = s.select("n1", "n0", u.alias("u_stat"), (n1 * n0 / 2).alias("mean_u"), sd.alias("sd_u"))
    z = F.greatest(F.abs(F.col("u_stat") - F.col("mean_u")) - 0.5, F.lit(0.0)) / F.col("sd_u")
    return out.withColumn("z", F.when(F.col("sd_u") > 0, z)).withColumn(
        "p_value", 2 * normal_upper(F.col("z"))
    )


def cohens_d(df: DataFrame, flag: str, value: str) -> DataFrame:
    """One row: means, population stds and Cohen's d of flag 1 against flag 0."""
    side = lambda v: F.when(F.col(flag) == v, F.col(value))
    t = df.agg(
        F.avg(side(1)).alias("mean_1"),
        F.stddev_pop(side(1)).alias("std_1"),
        F.avg(side(0)).alias("mean_0"),
        F.stddev_pop(side(0)).alias("std_0"),
    )
    pooled = F.sqrt((F.col("std_1") ** 2 + F.col("std_0") ** 2) / 2)
    return t.withColumn("cohens_d", (F.col("mean_1") - F.col("mean_0")) / (pooled + F.lit(1e-9)))


# -- regressions on a series of weeks ----------------------------------------


def active(series: DataFrame) -> DataFrame:
    """Weeks with an edge, with ``t`` counting them from 0 (a few rows per year)."""
    return series.where("n_edges > 0").withColumn(
        "t", F.row_number().over(Window.orderBy("week_num")) - 1
    )


def normal_sums(df: DataFrame, xs: Sequence[str], y: str) -> DataFrame:
    """One row: n, the sums x_i x_j and x_i y, and y'y."""
    cells = []
    for i, a in enumerate(xs):
        for j in range(i, len(xs)):
            cells.append(F.sum(F.col(a).cast("double") * F.col(xs[j])).alias(f"xx_{i}_{j}"))
        cells.append(F.sum(F.col(a).cast("double") * F.col(y)).alias(f"xy_{i}"))
    return df.agg(
        F.count(F.lit(1)).alias("n"),
        *cells,
        F.sum(F.col(y).cast("double") * F.col(y)).alias("yy"),
        F.sum(F.col(y).cast("double")).alias("y_sum"),
    )


def _solve(df: DataFrame, systems: dict[str, tuple[Sequence[str], str, str]]) -> DataFrame:
    """(name, n, rank, beta, inv, ss_res, ss_tot), one row per least-squares system.

    ``systems`` maps a name to (regressors, response, row condition).  All sums of
    all systems come from one aggregate; only the small matrices are solved in numpy.
    The coefficients, a handful of numbers, go into a second aggregate that sums the
    squared residuals themselves, so a close fit loses no digits.
    """
    df = cut(df)
    cells = []
    for name, (xs, y, cond) in systems.items():
        on = lambda e, c=cond: F.when(F.expr(c), e)
        for i, a in enumerate(xs):
            for j in range(i, len(xs)):
                cells.append(F.sum(on(F.col(a).cast("double") * F.col(xs[j]))).alias(f"{name}_xx_{i}_{j}"))
            cells.append(F.sum(on(F.col(a).cast("double") * F.col(y))).alias(f"{name}_xy_{i}"))
        cells.append(F.count(on(F.lit(1))).alias(f"{name}_n"))
        cells.append(F.sum(on(F.col(y).cast("double"))).alias(f"{name}_y"))
    sizes = {name: len(xs) for name, (xs, _, _) in systems.items()}
    columns = ["name", "n", "rank", "beta", "inv", "mean"]

    def solver(batches):
        for pdf in batches:
            rows = []
            for r in pdf.fillna(0.0).to_dict("records"):
                for name, k in sizes.items():
                    a = np.zeros((k, k))
                    for i in range(k):
                        for j in range(i, k):
                            a[i, j] = a[j, i] = r[f"{name}_xx_{i}_{j}"]
                    b = np.array([r[f"{name}_xy_{i}"] for i in range(k)])
                    n, ys = int(r[f"{name}_n"]), r[f"{name}_y"]
                    # Scaling to unit diagonal keeps the rank test independent of units.
                    d = np.sqrt(np.where(np.diag(a) > 0, np.diag(a), 1.0))
                    unit = a / np.outer(d, d)
                    rank = int(np.linalg.matrix_rank(unit, hermitian=True, tol=1e-9))
                    inv = np.linalg.inv(unit) / np.outer(d, d) if rank == k else np.linalg.pinv(a, hermitian=True, rcond=1e-12)
                    beta = inv @ b
                    rows.append((name, n, rank, beta.tolist(), np.diag(inv).tolist(), ys / n if n else 0.0))
            yield pd.DataFrame(rows, columns=columns)

    kind = "name string, n long, rank int, beta array<double>, inv array<double>, mean double"
    solved = {r["name"]: r for r in df.agg(*cells).mapInPandas(solver, kind).collect()}
    parts = []
    for name, (xs, y, cond) in systems.items():
        r = solved[name]
        fitted = sum((F.lit(beta) * F.col(x) for beta, x in zip(r["beta"], xs)), F.lit(0.0))
        square = lambda e, c=cond: F.coalesce(F.sum(F.when(F.expr(c), e * e)), F.lit(0.0))
        parts.append(
            F.struct(
                F.lit(name).alias("name"),
                F.lit(r["n"]).cast("long").alias("n"),
                F.lit(r["rank"]).alias("rank"),
                F.lit(r["beta"]).alias("beta"),
                F.lit(r["inv"]).alias("inv"),
                square(F.col(y).cast("double") - fitted).alias("ss_res"),
                square(F.col(y).cast("double") - F.lit(r["mean"])).alias("ss_tot"),
            )
        )
    return df.agg(F.array(*parts).alias("fits")).select(F.explode("fits").alias("f")).select("f.*")


ITS_TERMS = ["intercept", "time", "level", "trend"]


def segmented_regression(
    series: DataFrame, metric: str, festival: bool = False, min_weeks: int = 6
) -> DataFrame:
    """(term, coef, se, t, p, sig, r2, n, rank_deficient): interrupted time series.

    y = b0 + b1 time + b2 post + b3 weeks since the cut-over, over weeks with an
    edge.  ``festival=True`` adds the festival indicator.  A collinear design gets
    the minimum-norm solution and ``rank_deficient``.  Fewer than ``min_weeks``
    active weeks give no rows.
    """
    xs = ["one", "t", "post", "post_weeks"] + (["spring_festival"] if festival else [])
    terms = ITS_TERMS + (["festival"] if festival else [])
    fit = _solve(active(series).withColumn("one", F.lit(1.0)), {"its": (xs, metric, "true")})
    k = len(xs)
    df = F.greatest(F.col("n") - k, F.lit(1))
    rows = fit.where(F.col("n") >= min_weeks).select(
        "n",
        (F.col("rank") < k).alias("rank_deficient"),
        (1 - F.col("ss_res") / (F.col("ss_tot") + F.lit(1e-12))).alias("r2"),
        (F.col("ss_res") / df).alias("mse"),
        df.alias("df"),
        F.explode(F.arrays_zip(F.lit(terms).alias("term"), "beta", "inv")).alias("x"),
    )
    return (
        rows.select(
            F.col("x.term").alias("term"),
            F.col("x.beta").alias("coef"),
            F.sqrt(F.greatest(F.col("mse") * F.col("x.inv"), F.lit(0.0))).alias("se"),
            "r2",
            "n",
            "df",
            "rank_deficient",
        )
        .withColumn("t", F.col("coef") / (F.col("se") + F.lit(1e-12)))
        .withColumn("p", t_two_sided(F.col("t"), F.col("df")))
        .withColumn("sig", stars(F.col("p")))
        .select("term", "coef", "se", "t", "p", "sig", "r2", "n", "rank_deficient")
    )


def slopes(series: DataFrame, metric: str, as_coded: bool = False, min_weeks: int = 3) -> DataFrame:
    """(post, n, slope): trend of the active weeks before and after the cut-over.

    ``as_coded=True`` divides the sample covariance by the population variance.
    """
    y, t = F.col(metric).cast("double"), F.col("t").cast("double")
    slope = F.covar_samp(t, y) / F.var_pop(t) if as_coded else F.regr_slope(y, t)
    return (
        active(series).groupBy("post").agg(F.count(F.lit(1)).alias("n"), slope.alias("slope")).where(
            F.col("n") >= min_weeks
        )
    )


def pre_trend(series: DataFrame, metric: str, min_weeks: int = 3) -> DataFrame:
    """One row: slope, R² and p of a straight line through the active weeks before."""
    y, t = F.col(metric).cast("double"), F.col("t").cast("double")
    s = (
        active(series)
        .where("post = 0")
        .agg(F.count(F.lit(1)).alias("n"), F.regr_slope(y, t).alias("slope"), F.regr_r2(y, t).alias("r2"))
        .where(F.col("n") >= min_weeks)
    )
    df = F.col("n") - 2
    t_stat = F.sqrt(F.col("r2") * df / (1 - F.col("r2")))
    p = F.when(F.col("r2") >= 1, F.lit(0.0)).otherwise(t_two_sided(t_stat, df))
    return s.withColumn("p", p)


def lagged(series: DataFrame, metric: str, lags: int = 3, cause: str = "post") -> DataFrame:
    """The series with ``y_1..y_lags`` and ``x_1..x_lags`` (a few rows per year)."""
    order = Window.orderBy("week_num")
    base = series.select("week_num", F.col(metric).cast("double").alias("y"), F.col(cause).cast("double").alias("x"))
    return base.withColumns(
        {f"{c}_{k}": F.lag(c, k).over(order) for k in range(1, lags + 1) for c in ("y", "x")}
    )


def granger(series: DataFrame, metric: str, lags: Sequence[int] = (1, 2, 3), cause: str = "post") -> DataFrame:
    """(lag, f, p, df_num, df_den, sig, note): does the cut-over help predict the metric?

    All weeks count, also those without an edge.  A lag with too few weeks has a
    note and no numbers.
    """
    systems = {}
    for lag in lags:
        own = ["one", *[f"y_{i}" for i in range(1, lag + 1)]]
        full = own + [f"x_{i}" for i in range(1, lag + 1)]
        systems[f"own{lag}"] = (own, "y", f"y_{lag} is not null")
        systems[f"full{lag}"] = (full, "y", f"y_{lag} is not null")
    fits = _solve(lagged(series, metric, max(lags), cause).withColumn("one", F.lit(1.0)), systems)
    side = lambda kind: F.max(F.when(F.col("name").startswith(kind), F.col("ss_res")))
    lag, df = F.col("lag"), F.col("df_den")
    tests = (
        fits.groupBy(F.regexp_extract("name", "([0-9]+)$", 1).cast("int").alias("lag"))
        .agg(F.max("n").alias("n"), side("own").alias("ss_r"), side("full").alias("ss_u"))
        .withColumn("df_den", F.col("n") - 1 - 2 * lag)
    )
    gain = F.when(F.col("ss_r") > F.col("ss_u"), F.col("ss_r") - F.col("ss_u")).otherwise(0.0)
    f = F.when(F.col("ss_u") > 0, gain / lag / (F.col("ss_u") / df)).otherwise(0.0)
    enough = (F.col("n") + lag > 2 * lag + 2) & (df > 0)
    return (
        tests.withColumn("f", F.when(enough, f))
        .withColumn("p", F.when(enough, f_upper(F.col("f"), lag, df)))
        .select(
            "lag",
            "f",
            "p",
            lag.alias("df_num"),
            "df_den",
            F.coalesce(stars(F.col("p")), F.lit("")).alias("sig"),
            F.when(enough, "").otherwise("too few weeks").alias("note"),
        )
    )


# -- paired tests over seeds --------------------------------------------------


def paired_t(pairs: DataFrame, delta: str = "delta") -> DataFrame:
    """One row: n, mean and std of the differences, t and two-sided p."""
    s = pairs.agg(
        F.count(delta).alias("n"),
        F.avg(delta).alias("mean_delta"),
        F.stddev_pop(delta).alias("std_delta"),
        F.stddev_samp(delta).alias("sd"),
    )
    t = F.when(F.col("sd") > 0, F.col("mean_delta") / (F.col("sd") / F.sqrt("n")))
    return (
        s.withColumn("t", t)
        .withColumn("p", t_two_sided(F.col("t"), F.col("n") - 1))
        .select("n", "mean_delta", "std_delta", "t", "p")
    )


def wilcoxon_greater(pairs: DataFrame, delta: str = "delta", exact_up_to: int = 60) -> DataFrame:
    """One row: n, w and the one-sided p that the differences are positive.

    Zero differences are dropped and tied sizes share their mean rank.  Up to
    ``exact_up_to`` pairs the null distribution is counted over all sign patterns,
    by adding one rank at a time; beyond that it is normal with the variance of
    the tied ranks, from aggregates alone.
    """
    used = pairs.select(F.col(delta).cast("double").alias("d")).where("d is not null and d <> 0")
    packed = used.groupBy(F.abs("d").alias("size")).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("d") > 0, 1)).alias("up")
    )
    ranks = cut(average_ranks(packed, "size"))
    rank, n = F.col("avg_rank"), F.col("n")
    totals = ranks.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n"),
        F.sum(F.col("up") * rank).alias("w"),
        F.sum(n * rank).alias("whole"),
        F.sum(n * rank * rank).alias("squares"),
    )
    found = totals.first()
    if found["n"] > exact_up_to:
        z = (F.col("w") - F.col("whole") / 2) / F.sqrt(F.col("squares") / 4)
        return totals.select("n", "w", normal_upper(z).alias("p"))
    listed = ranks.agg(F.collect_list(F.struct("avg_rank", "n")).alias("ranks"))  # exact_up_to ranks at most

    def exact(batches):
        for pdf in batches:
            out = []
            for ranks in pdf["ranks"]:
                steps = [int(round(2 * r["avg_rank"])) for r in ranks for _ in range(int(r["n"]))]
                ways = np.zeros(sum(steps) + 1)
                ways[0] = 1
                for s in steps:
                    shifted = np.zeros_like(ways)
                    shifted[s:] = ways[: len(ways) - s]
                    ways = ways + shifted
                out.append((list(ways[::-1].cumsum()[::-1] / ways.sum()),))
            yield pd.DataFrame(out, columns=["tail"])

    tail = listed.mapInPandas(exact, "tail array<double>")
    w = F.lit(found["w"]).cast("double")
    p = F.element_at("tail", F.round(2 * w).cast("int") + 1) if found["n"] else F.lit(None).cast("double")
    return tail.select(F.lit(found["n"]).cast("long").alias("n"), w.alias("w"), p.alias("p"))
