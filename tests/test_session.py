"""Shuffle partitions by the size of the tables."""

from pyspark.sql import functions as F

from coloom import session as S
from coloom.operators import colocation as L


def test_partitions_grow_with_the_rows(spark):
    before = {key: spark.conf.get(key) for key in (S.PARTITIONS, S.ADVISORY)}
    try:
        S.size_shuffles(spark, 40 * S.ROWS)
        assert spark.conf.get(S.PARTITIONS) == "40" and spark.conf.get(S.ADVISORY) == S.READ
        S.size_shuffles(spark, 7 * S.ROWS + 1)
        assert spark.conf.get(S.PARTITIONS) == "8"
        S.size_shuffles(spark, 10)
        assert {key: spark.conf.get(key) for key in before} == before
        S.size_shuffles(spark, 40 * S.ROWS)
        spark.conf.set(S.PARTITIONS, "60")  # the session's owner has the last word
        S.size_shuffles(spark, 40 * S.ROWS)
        assert spark.conf.get(S.PARTITIONS) == "60"
        S.size_shuffles(spark, 70 * S.ROWS)
        S.size_shuffles(spark, 10)
        assert spark.conf.get(S.PARTITIONS) == "60"
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_a_task_holds_no_more_rows_of_more_visits(spark, monkeypatch):
    from coloom.sources import tables as T

    monkeypatch.setattr(S, "ROWS", 500)
    before = {key: spark.conf.get(key) for key in (S.PARTITIONS, S.ADVISORY)}
    try:
        visits = T.ship_visits(spark, "/root/testdata/sf0.001")
        wide = int(spark.conf.get(S.PARTITIONS))
        assert wide >= T.table(spark, "/root/testdata/sf0.001", "lineitem").count() / 500
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        rows = L.edges(L.members(visits, 0)).groupBy(F.spark_partition_id()).count().collect()
        assert len(rows) > 4
    finally:
        for key in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(key)
        for key, value in before.items():
            spark.conf.set(key, value)


def test_free_shuffles_deletes_files_of_plans_that_are_gone(spark):
    import time

    from coloom.session import cut, free_shuffles

    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    free_shuffles(spark)
    time.sleep(1)
    before = files.getAllFiles().size()
    kept = cut(spark.range(1000).repartition(4, "id"))
    assert files.getAllFiles().size() > before
    free_shuffles(spark)
    end = time.time() + 20
    while files.getAllFiles().size() > before and time.time() < end:
        time.sleep(0.2)
    assert files.getAllFiles().size() <= before and kept.count() == 1000
