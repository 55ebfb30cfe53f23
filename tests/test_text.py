import datetime as dt
import tempfile

from pyspark.sql import functions as F

from coloom.functions import text as X
from coloom.operators.extract import extract_case_details, extract_cases, extract_events, visits_of
from coloom.sources.reports import read_case_blocks, read_cases, read_texts, split_cases

D = dt.date


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("x")).first().x


def blocks(spark, text, province="湖北省"):
    return split_cases(spark.createDataFrame([(province, text)], "province string, content string"))


def test_split_drops_text_before_the_first_marker(spark):
    rows = extract_cases(blocks(spark, "前言。第1号确诊病例，男，30岁。第2号确诊病例，女。")).orderBy("case_id").collect()
    assert [(r.case_id, r.age, r.gender) for r in rows] == [("湖北_1", 30, "M"), ("湖北_2", None, "F")]


def test_sentences_need_a_terminator(spark):
    assert one(spark, "1月22日到医院就诊。发热；回家", X.sentences) == ["1月22日到医院就诊。", "发热；"]
    assert one(spark, "。；。好；　出行了。", X.sentences) == ["出行了。"]


def test_symptom_only_sentence_is_no_event(spark):
    rows = extract_events(blocks(spark, "第1号确诊病例，1月22日到医院就诊。发热；回家")).collect()
    assert len(rows) == 1
    assert rows[0].date == D(2020, 1, 22) and rows[0].venues == ["医院"] and rows[0].is_lockdown is False


def test_cascade_priority(spark):
    texts = {"乘高铁到医院": 4, "乘高铁去超市": 8, "朋友来访": 6, "无": 9, "在家中": 5, "前往外地": 1}
    assert {t: one(spark, t, X.event_type) for t in texts} == texts


def test_dates(spark):
    expected = {
        "1月22日": [D(2020, 1, 22)],
        "2019年12月30日": [D(2019, 12, 30)],
        "2月30日": [],
        "1月22日-26日": [D(2020, 1, 22), D(2020, 1, 26)],
        "1月30日至2月3日": [D(2020, 1, 30), D(2020, 2, 3)],
        "１月２日": [D(2020, 1, 2)],
        "1月22日至2月": [D(2020, 1, 22)],
        "无": [],
    }
    assert {t: one(spark, t, X.date_mentions) for t in expected} == expected


def test_statistics_dates_count_full_dates_once_unless_as_coded(spark):
    t = "2019年12月30日，1月5日"
    assert one(spark, t, X.all_dates) == [D(2019, 12, 30), D(2020, 1, 5)]
    coded = one(spark, t, lambda c: X.all_dates(c, as_coded=True))
    assert sorted(coded) == [D(2019, 12, 30), D(2020, 1, 5), D(2020, 12, 30)]


def test_overlapping_keywords_are_all_seen(spark):
    assert one(spark, "回家中途到发热门诊", X.venue_types) == sorted(["家庭", "医院"])
    assert one(spark, "坐高铁站旁大巴", X.transport_codes) == ["bus", "train_hsr"]


def test_undated_event_has_no_period(spark):
    rows = extract_events(blocks(spark, "第1号确诊病例，去了超市。")).collect()
    assert rows[0].date is None and rows[0].is_lockdown is None


def test_case_details(spark):
    r = extract_case_details(blocks(spark, "第7号确诊病例，女，约45岁，武汉人，无症状。体温正常，1月5日到诊所，1月2日回家")).first()
    assert (r.case_id, r.age, r.gender) == ("7", 45, "女")
    assert r.is_asymptomatic and r.wuhan_connection
    assert (r.first_date, r.last_date) == (D(2020, 1, 2), D(2020, 1, 5))
    assert r.symptoms == ["发热"] and r.venues == sorted(["医院", "家庭"])


def test_case_number_patterns(spark):
    expected = {"第12号确诊病例": "12", "第3号": "3", "病例45": "45", "确诊6例": "6", "无": None}
    assert {t: one(spark, t, X.case_number) for t in expected} == expected


def test_labels(spark):
    assert one(spark, "北京市确诊病例活动轨迹", X.province_label) == "Beijing"
    assert one(spark, "某某省确诊病例", X.province_label) == "某某"
    assert one(spark, "", X.province_label) == "Unknown"
    assert one(spark, "药店", X.venue_label) == "Pharmacy"


def test_files_read_whole_or_in_splits_give_the_same_cases(spark):
    folder = tempfile.mkdtemp(prefix="coloom-test-", dir="/tmp")
    texts = {
        "湖北省确诊病例活动轨迹.txt": "前言第一。第1号确诊病例，男，30岁。第二天1月22日到医院就诊。第２号确诊病例，女。第三" * 5,
        "北京市确诊病例行程轨迹.txt": "第1号确诊病例，女",
        "c.txt": "1号确诊病例，女",
    }
    for name, text in texts.items():
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    whole = split_cases(read_texts(spark, folder)).select("province", "case_seq", "case_id", "case_text").collect()
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("37", "64", "1000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            parts = read_case_blocks(spark, folder).select("province", "case_seq", "case_id", "case_text").collect()
            assert sorted(map(tuple, parts)) == sorted(map(tuple, whole))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert len(whole) == 11


def test_cases_across_chunks(spark, monkeypatch):
    """Cases inside a chunk, across two and across several, in a file of one split; texts are shuffled once but for the borders."""
    from coloom.sources import reports

    folder = tempfile.mkdtemp(prefix="coloom-test-", dir="/tmp")
    texts = {
        "a省确诊病例.txt": "第1号确诊病例，女。" + "第二天。第三天。" * 9 + "".join(f"第{i}号确诊病例，男。第{i}天。" for i in range(2, 40)),
        "b省确诊病例.txt": "开头。第二。第三。第四。第五。第1号确诊病例，女",
        "c.txt": "1号确诊病例，女。第2号确诊病例，男",
        "d.txt": "没有",
    }
    for name, text in texts.items():
        with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
            f.write(text)
    whole = split_cases(read_texts(spark, folder)).select("province", "case_seq", "case_id", "case_text").collect()
    for size in (0, 1, 2, 12):
        monkeypatch.setattr(reports, "CHUNK", size)
        parts = read_case_blocks(spark, folder).select("province", "case_seq", "case_id", "case_text").collect()
        assert sorted(map(tuple, parts)) == sorted(map(tuple, whole))


def test_cases_are_put_together_where_they_are_read(monkeypatch):
    """The text of all pieces was shuffled; now only a split's first and last case are."""
    import pyarrow as pa
    from coloom.sources import reports

    monkeypatch.setattr(reports, "BATCH", 2)
    rows = [("a", 0, True, "1号确诊病例"), ("a", 0, True, "2号确诊病例"), ("a", 0, False, "二天"), ("a", 0, True, "3号确诊病例"), ("a", 9, False, "四"), ("a", 9, True, "4号确诊病例"), ("b", 0, False, ""), ("b", 0, False, "五")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("path", "split", "marked", "piece"), row))]) for row in rows]
    got = [tuple(r.values()) for b in reports._cases_of_splits("第")(iter(batches)) for r in b.to_pylist()]
    assert got == [
        ("a", 0, 0, "1号确诊病例"),
        ("a", 0, 1, "2号确诊病例第二天"),
        ("a", 0, 2, "3号确诊病例"),
        ("a", 9, 0, "四"),
        ("a", 9, 1, "4号确诊病例"),
        ("b", 0, 0, "第五"),
    ]


def test_dates_at_the_edges(spark):
    def dates(text):
        return one(spark, text, lambda t: F.transform(X.date_mentions(t), lambda d: d.cast("string")))

    assert dates("２０１９年１２月３１日至１月２日；2020年2月29日，2021年2月29日，13月1日，0月3日，4月31日，4月0日") == ["2019-12-31", "2019-01-02", "2020-02-29"]
    assert dates("1月5日至2月30日，1月5日—7，01月05日~2月3日，0000年1月1日") == ["2020-01-05", "2020-01-07", "2020-01-05", "2020-02-03", "0000-01-01"]


def test_json_records_are_compressed_and_bounded(spark, monkeypatch):
    """Names and words repeat in every record: as plain text they took most of the disk."""
    import glob
    from coloom.sources import sinks
    from coloom.sources.reports import CASES

    folder = tempfile.mkdtemp(prefix="coloom-test-", dir="/tmp")
    rows = [(f"a_{i}", None if i % 3 else "p", i, None, 0, 1, D(2020, 1, 5), None) for i in range(25)]
    monkeypatch.setattr(sinks, "RECORDS", 10)
    sinks.write_json(spark.createDataFrame(rows, CASES).coalesce(1), folder)
    assert len(glob.glob(f"{folder}/*.json.gz")) == 3 and not glob.glob(f"{folder}/*.json")
    assert sorted(map(tuple, read_cases(spark, folder).collect())) == sorted(rows)
    assert '"gender":null' in spark.read.text(folder).first().value


def test_read_cases_json(spark):
    folder = tempfile.mkdtemp(prefix="coloom-test-", dir="/tmp")
    with open(f"{folder}/cases.json", "w", encoding="utf-8") as f:
        f.write('[\n {"case_id": "a_1", "province": "p", "age": null, "first_date": "2020-01-05"}\n]')
    r = read_cases(spark, f"{folder}/cases.json", array=True).first()
    assert r.case_id == "a_1" and r.age is None and r.first_date == D(2020, 1, 5)


def test_visits_of(spark):
    ev = extract_events(blocks(spark, "第1号确诊病例，1月5日在超市。在医院。"))
    assert sorted((r.venue, r.day) for r in visits_of(ev).collect()) == [("公共场所", D(2020, 1, 5)), ("超市", D(2020, 1, 5))]
