"""Every registered query with SQL gives the same rows on the smallest tables."""

import os
import re

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
# Fits; the models have a test of their own.
SLOW = {n for n in queries() if n.endswith("_scores")} | {"feature_importance"}


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert compare(df, duck, oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - SLOW))
def test_query_without_sql(spark, name):
    assert queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", ["extraction_stats", "seed_metric_summary", "auc_ap_confusion", "crowd_multi_edge_count"])
def test_tables_are_scanned_once(spark, name):
    df = queries()[name](spark, SF)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    scans = re.findall(r"FileScan parquet .*?/(\w+)\.parquet", plan)
    assert len(scans) == len(set(scans)), scans
