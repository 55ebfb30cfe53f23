"""The whole analysis on a few written reports, and the streaming twin."""

import datetime as dt
import random
import tempfile

from pyspark.sql import functions as F

from coloom.operators import models as ML
from coloom.plans import steps
from coloom.sources import sinks
from coloom.sources.layout import Layout
from coloom.streaming.live import stream_events, weekly_counts


def write_reports(folder, n=120):
    rng = random.Random(4)
    places = ["医院", "超市", "餐厅", "家中", "公司", "药店"]
    rides = ["高铁", "大巴", "自驾"]
    for name in ("湖北省", "北京市", "上海市"):
        text = "通报。"
        for i in range(1, n + 1):
            text += f"第{i}号确诊病例，{rng.choice('男女')}，{rng.randrange(5, 80)}岁。"
            for _ in range(rng.randrange(1, 4)):
                day = dt.date(2020, 1, 3) + dt.timedelta(rng.randrange(60))
                text += f"{day.month}月{day.day}日乘{rng.choice(rides)}到{rng.choice(places)}。"
            if rng.random() < 0.2:
                text += "无症状。"
        with open(f"{folder}/{name}确诊病例活动轨迹.txt", "w", encoding="utf-8") as f:
            f.write(text)


def test_all_steps(spark):
    base = tempfile.mkdtemp(prefix="coloom-test-", dir="/tmp")
    layout = Layout(base)
    import os

    os.makedirs(layout.raw_text())
    write_reports(layout.raw_text())
    study = steps.Study(
        spark, layout, seeds=(42,), models=("LR", "GBM"), settings={"GBM": {"maxIter": 3, "maxDepth": 3}}
    )
    steps.run(study, ["ablation", "tables"])
    read = lambda name: spark.read.parquet(layout.result(name))
    assert study.cases.count() == 360
    assert read("extraction_stats").first().total_cases == 360
    assert read("dataset_stats").first().coverage == "SUFFICIENT"
    assert read("province_stats").count() == 3
    assert read("venue_risk").where("rank = 1").count() == 1
    assert read("group_contrast").count() == 4
    assert read("weekly_series").count() == 9
    assert read("seed_summary").count() == 12
    graph = sinks.read_graph(spark, layout.data("graph"))
    assert {r.dst_type for r in graph["edges"].select("dst_type").distinct().collect()} >= {"case", "venue", "date", "transport"}
    assert graph["splits"].count() == 360
    before = study.cases.inputFiles()
    steps.run(study, ["ablation", "tables"])
    assert study.cases.inputFiles() == before


def test_models_learn_a_separable_label(spark):
    rng = random.Random(0)
    rows = [(i, "train" if i % 4 else "test", a, b, int(a + b > 1)) for i, (a, b) in enumerate((rng.random(), rng.random()) for _ in range(400))]
    data = spark.createDataFrame(rows, "case_id long, split string, a double, b double, label int")
    for name, kw in (("LR", {}), ("RF", {"numTrees": 10}), ("GBM", {"maxIter": 5}), ("MLP", {"hidden": [6]}), ("SVM", {"dims": 64})):
        assert ML.evaluate(name, data, ["a", "b"], **kw).first()["AUC-ROC"] > 0.9


def test_streaming_counts_equal_batch(spark):
    from coloom.operators.extract import extract_events
    from coloom.sources.reports import split_cases

    folder = tempfile.mkdtemp(prefix="coloom-test-", dir="/tmp")
    text = "第1号确诊病例，1月3日在超市。1月12日在医院。1月13日在家中。第2号确诊病例，2月20日到公司。"
    spark.createDataFrame([("湖北省", text)], "province string, content string").write.mode("overwrite").parquet(folder)
    stream = spark.readStream.schema("province string, content string").parquet(folder)
    anchor = dt.date(2020, 1, 3)
    q = (
        weekly_counts(stream_events(stream), anchor)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("weeks")
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    got = {r.week_start: r.n_events for r in spark.table("weeks").collect()}
    batch = extract_events(split_cases(spark.read.parquet(folder))).where("date is not null")
    week = F.date_add(F.lit(anchor), (F.floor(F.datediff("date", F.lit(anchor)) / 7) * 7).cast("int"))
    assert got == {r.w: r["count"] for r in batch.groupBy(week.alias("w")).count().collect()}
