import datetime as dt
import math
import random

from pyspark.sql import functions as F

from coloom.functions.distributions import beta_inc, f_upper, normal_upper, stars, t_two_sided
from coloom.operators import inference as I
from coloom.operators import metrics as M
from coloom.operators import statistics as S
from coloom.operators.features import date_features, row_stats, without
from coloom.operators.ranking import average_ranks, ranked, running_totals
from coloom.operators.report import ablation_table, latex_table
from coloom.operators.split import hash_split


def value(spark, e):
    return spark.range(1).select(e.alias("x")).first().x


def test_distributions(spark):
    lit = F.lit
    # Closed forms: t with 1 and 2 degrees of freedom, F with 2 numerator degrees.
    assert abs(value(spark, t_two_sided(lit(1.0), lit(1))) - 0.5) < 1e-12
    assert abs(value(spark, t_two_sided(lit(2.0), lit(2))) - (1 - 2 / math.sqrt(6))) < 1e-12
    assert abs(value(spark, f_upper(lit(3.0), lit(2), lit(10))) - (1 + 2 * 3.0 / 10) ** -5) < 1e-12
    assert abs(value(spark, beta_inc(lit(2.0), lit(3.0), lit(0.4))) - 0.5248) < 1e-12
    for z in (0.0, 0.5, 1.96, 4.0, 7.0):
        assert abs(value(spark, normal_upper(lit(z))) - math.erfc(z / math.sqrt(2)) / 2) < 1e-14
    assert value(spark, t_two_sided(lit(None).cast("double"), lit(3))) is None
    assert [value(spark, stars(lit(p))) for p in (0.0001, 0.005, 0.02, 0.5)] == ["***", "**", "*", ""]


def test_anova(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 4.0), ("b", 6.0), ("c", 5.0), ("c", 9.0), ("d", 1.0)], "g string, v double")
    r = I.anova(df, "g", "v", 2).first()
    assert abs(r.ss_between - 31) < 1e-12 and abs(r.ss_within - 10.5) < 1e-12
    assert abs(r.f_stat - 31 / 7) < 1e-12
    assert abs(r.p_value - (1 + 2 * (31 / 7) / 3) ** -1.5) < 1e-12


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.5, 1), (3, 0.5, 0), (4, 0.1, 0)], "id int, score double, label int")
    r = M.classification_metrics(df).first()
    assert r["AUC-ROC"] == 0.875 and abs(r["AP"] - 5 / 6) < 1e-12 and r["Accuracy"] == 0.75
    flipped = M.classification_metrics(df.withColumn("score", 1 - F.col("score"))).first()
    assert abs(r["AUC-ROC"] + flipped["AUC-ROC"] - 1) < 1e-12
    assert M.precision_at_k(df, 2).first()[0] == 1.0
    assert M.precision_at_k(df, 100).first()[0] == 0.5


def test_running_totals_and_ranks(spark):
    rng = random.Random(1)
    keys = sorted({round(rng.random() ** 5, 5) for _ in range(700)})
    df = spark.createDataFrame([(k, i % 3) for i, k in enumerate(keys)], "k double, n long").repartition(5)
    total, want = 0, {}
    for i, k in enumerate(keys):
        want[k] = total
        total += i % 3
    assert {r.k: r.before_n for r in running_totals(df, "k", ["n"], 16).collect()} == want
    out = ranked(spark.range(500).withColumn("k", F.col("id") % 7), [F.desc("k"), F.col("id")]).collect()
    by = sorted(out, key=lambda r: (-r.k, r.id))
    assert [r["rank"] for r in by] == list(range(1, 501))
    ties = spark.createDataFrame([(1.0, 2), (3.0, 1), (5.0, 3)], "v double, n long")
    assert {r.v: r.avg_rank for r in average_ranks(ties, "v").collect()} == {1.0: 1.5, 3.0: 3.0, 5.0: 5.0}


def test_mann_whitney_and_cohens_d(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 7.0), (1, 7.0), (0, 1.0), (0, 7.0), (0, 2.0), (0, 3.0)], "y int, v double")
    r = I.mann_whitney(df, "y", "v").first()
    # ranks 5, 5 (7.0 has rank 6): U = 4 + 6 + 6 - 6
    assert r.u_stat == 10.0 and r.mean_u == 6.0
    sd = math.sqrt(12 / 12 * (8 - 24 / 42))
    assert abs(r.z - 3.5 / sd) < 1e-12
    assert abs(r.p_value - math.erfc(3.5 / sd / math.sqrt(2))) < 1e-12
    d = I.cohens_d(df, "y", "v").first()
    pooled = math.sqrt((8 / 9 + 83 / 16) / 2)
    assert abs(d.cohens_d - (19 / 3 - 3.25) / (pooled + 1e-9)) < 1e-9


def series(spark, y, post_from, festival_from=None):
    start = dt.date(2020, 1, 1)
    rows = [
        (start + dt.timedelta(7 * i), i, int(i >= post_from), int(i >= (post_from if festival_from is None else festival_from)),
         max(i - post_from, 0), 1, float(v))
        for i, v in enumerate(y)
    ]
    return spark.createDataFrame(
        rows, "week_start date, week_num int, post int, spring_festival int, post_weeks int, n_edges long, y double"
    )


def test_segmented_regression_recovers_coefficients(spark):
    y = [2 + 0.5 * t + (3 - 0.25 * (t - 6) if t >= 6 else 0) for t in range(14)]
    rows = {r.term: r for r in I.segmented_regression(series(spark, y, 6), "y").collect()}
    for term, coef in (("intercept", 2), ("time", 0.5), ("level", 3), ("trend", -0.25)):
        assert abs(rows[term].coef - coef) < 1e-8
    assert not rows["time"].rank_deficient and rows["time"].r2 > 1 - 1e-9
    both = I.segmented_regression(series(spark, y, 6), "y", festival=True).collect()
    assert all(r.rank_deficient for r in both)
    assert I.segmented_regression(series(spark, y[:5], 3), "y").count() == 0


def test_trends(spark):
    s = series(spark, [2, 4, 9, 1, 1, 1], 3).withColumn("n_edges", F.when(F.col("week_num") < 3, 1).otherwise(0))
    r = I.pre_trend(s, "y").first()
    assert r.n == 3 and abs(r.slope - 3.5) < 1e-12
    good, coded = (I.slopes(s, "y", as_coded=c).first().slope for c in (False, True))
    assert abs(good - 3.5) < 1e-12 and abs(coded - 3.5 * 3 / 2) < 1e-12


def test_granger_lags(spark):
    rng = random.Random(2)
    rows = I.granger(series(spark, [rng.random() for _ in range(20)], 9), "y").orderBy("lag").collect()
    assert [(r.lag, r.df_num, r.df_den, r.note) for r in rows] == [(1, 1, 16, ""), (2, 2, 13, ""), (3, 3, 10, "")]
    assert all(0 <= r.p <= 1 for r in rows)
    short = I.granger(series(spark, [1, 2, 1, 3, 1, 2], 3), "y").orderBy("lag").collect()
    assert [r.note for r in short] == ["", "too few weeks", "too few weeks"]
    assert short[2].f is None and short[2].p is None


def test_paired_tests(spark):
    deltas = [0.1, 0.2, 0.05, 0.3, 0.02]
    df = spark.createDataFrame([(i, d) for i, d in enumerate(deltas)], "seed int, delta double")
    t = I.paired_t(df).first()
    assert abs(t.t - 2.600104261) < 1e-8 and t.n == 5
    w = I.wilcoxon_greater(df).first()
    assert (w.n, w.w, w.p) == (5, 15.0, 1 / 32)
    neg = I.wilcoxon_greater(df.withColumn("delta", -F.col("delta"))).first()
    assert (neg.w, neg.p) == (0.0, 1.0)


def test_coverage(spark):
    cut = dt.date(2020, 1, 23)
    for days, verdict in (((-7, 14), "SUFFICIENT"), ((-6, 14), "LIMITED"), ((-3, -1), "PRE_ONLY"), ((0, 5), "POST_ONLY"), ((), "UNKNOWN")):
        df = spark.createDataFrame([(cut + dt.timedelta(d),) for d in days], "date date")
        assert S.coverage(df, cut).first().coverage == verdict


def test_daily_counts_fill_gaps(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 22),), (dt.date(2020, 1, 25),)], "date date")
    rows = [(r["count"], r.period) for r in S.daily_counts(df).orderBy("date").collect()]
    assert rows == [(1, "pre"), (0, "post"), (0, "post"), (1, "post")]


def test_top_items_and_map(spark):
    df = spark.createDataFrame([("p", x) for x in "aabbcdefg"], "g string, x string")
    top = S.top_items(df, "g", "x", 3)
    assert [(r.x, r.n) for r in top.orderBy("rank").collect()] == [("a", 2), ("b", 2), ("c", 1)]
    assert S.top_map(top, "g", "x").first().top == {"a": 2, "b": 2, "c": 1}


def test_split_sizes_and_repeatability(spark):
    df = spark.range(1003).withColumnRenamed("id", "case_id")
    a = {r.case_id: r.split for r in hash_split(df).collect()}
    b = {r.case_id: r.split for r in hash_split(df.repartition(7)).collect()}
    c = {r.case_id: r.split for r in hash_split(df, seed=123).collect()}
    assert a == b and a != c
    assert [list(a.values()).count(s) for s in ("train", "val", "test")] == [702, 100, 201]


def test_split_sizes_are_exact_shares(spark):
    # 0.7 * 90 is 62.99 in doubles.
    rows = hash_split(spark.range(90).withColumnRenamed("id", "case_id")).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in rows} == {"train": 63, "val": 9, "test": 18}


def test_row_stats_and_groups(spark):
    df = spark.createDataFrame([(1, 0.0, 0.4, 0.8, 0.2)], "case_id int, a double, b double, c double, t double")
    r = row_stats(df, ["a", "b", "c"], ["t"]).first()
    assert abs(r.venue_total - 1.2) < 1e-12 and r.venue_max == 0.8 and r.venue_diversity == 2.0
    assert abs(r.venue_std - math.sqrt(0.32 / 3)) < 1e-12
    assert without(["age_norm", "is_male", "venue_0", "venue_max"], "venue", "gender") == ["age_norm"]


def test_date_features_monday_is_zero(spark):
    r = date_features(spark.createDataFrame([(dt.date(2020, 1, 20),)], "date date")).first()
    assert r.dow_sin == 0.0 and r.dow_cos == 1.0 and r.days_norm == -0.03


def test_tables(spark):
    df = spark.createDataFrame([("full", 0.9, 0.8), ("w/o x", 0.85, 0.9)], "variant string, `AUC-ROC` double, F1 double")
    tex = ablation_table(df, "full", ["AUC-ROC", "F1"], "c", "l")
    assert "full & 0.9000 & 0.8000" in tex and "w/o x & 0.8500 (-0.0500) & 0.9000 (+0.1000)" in tex
    assert "-- " in latex_table(spark.sql("select 1 a, cast(null as double) b"), [("a", "A", "d"), ("b", "B", ".2f")], "c", "l")
