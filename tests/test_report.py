import datetime as dt

from coloom.operators import report as R
from coloom.plans import risk
from coloom.sources.layout import Layout

METRICS = ["AUC-ROC", "F1"]


def visits(spark):
    day = dt.date(2020, 1, 1)
    rows = [(f"c{i}", p, "医院", day) for i, p in enumerate("xxxxxyyyyy")] + [("c0", "x", "学校", day)]
    return spark.createDataFrame(rows, "case_id string, province string, venue string, day date")


def test_risk_ranking_with_importance(spark):
    imp = spark.createDataFrame([("venue_医院", 0.25), ("age_norm", 0.5)], "name string, importance double")
    rows = {r.venue: r for r in risk.venue_risk_ranking(visits(spark), imp).collect()}
    top = rows["医院"]
    assert (top["rank"], top.avg_risk, top.n_cases, top.n_provinces, top.feature_importance) == (1, 1.0, 10, 2, 0.25)
    low = rows["学校"]
    assert (low["rank"], low.avg_risk, low.cluster_rate, low.n_provinces, low.feature_importance) == (2, 0.0, 1.0, 0, 0.0)


def test_printed_tables(spark):
    tex = R.venue_table(risk.venue_risk_ranking(visits(spark)))
    assert r"1 & 医院 & 1.0000 & 10 & 2 \\" in tex and tex.index("医院") < tex.index("学校")
    scores = spark.createDataFrame([("LR", 0.9, 0.8), ("RF", 0.95, 0.7)], "model string, `AUC-ROC` double, F1 double")
    tex = R.metrics_table(scores, METRICS)
    assert tex.index("RF & 0.9500") < tex.index("LR & 0.9000")
    change = spark.createDataFrame([("density", 0.5, 0.25, -50.0)], "metric string, pre double, post double, change_pct double")
    assert r"density & 0.500000 & 0.250000 & -50.0 \\" in R.change_table(change)
    contrast = spark.createDataFrame(
        [("degree", 1.0, 0.5, 2.0, 0.25, 0.04, -1.5)],
        "metric string, mean_1 double, std_1 double, mean_0 double, std_0 double, p_value double, cohens_d double",
    )
    assert "degree & 1.0000 & 0.5000 & 2.0000 & 0.2500 & 0.0400 & -1.5000" in R.contrast_table(contrast)


def test_layout():
    at = Layout("hdfs://x/base/")
    assert at.raw_text() == "hdfs://x/base/raw_text" and at.result("a") == "hdfs://x/base/results/a"
    assert at.figure("f.png") == "hdfs://x/base/paper/figures/f.png"
