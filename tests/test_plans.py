"""Plan shape checks: pushdown, no Python in the hot path, one shuffle where one is enough,
top-k limits pushed below the shuffle."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from keelson.plans.catalog import queries

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas", "PythonRDD")


def _plan(spark, name):
    df = queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries()))
def test_no_python_execution_in_plans(spark, name):
    plan = _plan(spark, name)
    assert not any(n in plan for n in PYTHON_NODES), name


def test_filters_reach_the_scan(spark):
    plan = _plan(spark, "select_value_rows")
    assert "PushedFilters: [IsNotNull(l_returnflag), EqualTo(l_returnflag,R)]" in plan
    plan = _plan(spark, "drop_sessions_below")
    assert "LessThan(value,1.0)" in plan


def test_projection_is_pruned_at_the_scan(spark):
    plan = _plan(spark, "value_counts")
    scans = [line for line in plan.splitlines() if "ReadSchema" in line or "FileScan" in line]
    assert scans and all("html" not in s and "props:string,ts" not in s for s in scans)
    assert "ReadSchema: struct<props:string>" in plan


def test_outcome_funnel_shuffles_once_on_the_entity(spark):
    plan = _plan(spark, "outcome_funnel")
    assert plan.count("Exchange hashpartitioning(session_id") == 1


def test_threshold_penetration_scans_events_once(spark):
    plan = _plan(spark, "threshold_penetration")
    assert plan.count("events.parquet") == 1


@pytest.mark.parametrize("name", ["feature_profile", "vocabulary_merge"])
def test_topk_is_ranked_in_hash_buckets_first(spark, name):
    plan = _plan(spark, name)
    assert "_salt" in plan and "xxhash64" in plan


def test_articles_of_one_file_are_spread_over_all_partitions(spark, tmp_path):
    from keelson.plans.views import articles

    docs = spark.createDataFrame([(i, "x") for i in range(400)], "doc_id long, text string")
    pages = spark.createDataFrame([(i, "<body>y</body>") for i in range(400)], "page_id long, html string")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    pages.coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = articles(spark, str(tmp_path)).where(F.col("article_id").startswith("p"))
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 400 and len(counts) == n and max(counts) <= 400 // n + 1
