"""No cuts, no switches by size: many classes, unbalanced labels, long runs of breaks, a sink used twice."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from keelson import session
from keelson.functions.sampling import unit_hash
from keelson.functions.text import rich_text, strip_html
from keelson.operators.counts import multi_value_counts
from keelson.operators.feature_map import feature_map
from keelson.operators.importance import feature_importance
from keelson.operators.sampling import (
    balance_then_sample,
    balance_to_minority,
    sample_fraction,
    sample_to_cap,
    split_train_test,
)
from keelson.operators.vocabulary import vocabulary_merge
from keelson.plans.catalog import queries
from keelson.sources import partitions
from keelson.streaming.stateless import clean_articles_stream


@pytest.mark.parametrize("classes", [10, 1001])
def test_balance_is_one_plan(spark, classes):
    df = spark.range(classes * 4).select("id", (F.col("id") % classes).alias("cls"), F.lit(1).alias("z"))
    df = df.union(spark.range(5000, 5003).select("id", F.lit(0).cast("long"), F.lit(2)))
    out = balance_to_minority(df, "cls", key="id")
    assert out.columns == df.columns
    counts = {r["cls"]: r["count"] for r in out.groupBy("cls").count().collect()}
    assert all(counts[c] == 4 for c in range(1, classes)) and counts[0] <= 7


def test_unbalanced_keeps_every_label(spark):
    df = spark.createDataFrame([(i, [0.0, 1.0, 2.0, None][i % 4]) for i in range(40)], "id long, label double")
    assert balance_then_sample(df).count() == 40
    assert sample_to_cap(df, None).count() == 40


def test_long_runs_of_breaks(spark):
    page = "a" + "<br>" * 100_000 + "\n" * 100_000 + "b"
    rows = [(page,), ("<header>kept</header><p>x</p><head><title>t</title></head>y",), ('m<br class="c">n',)]
    got = [r[0] for r in spark.createDataFrame(rows, "h string").select(strip_html(F.col("h"))).collect()]
    assert got[0] == "a\nb"
    assert "kept" in got[1] and "t" not in got[1].replace("kept", "")
    assert got[2] == "m\nn"


def test_stream_goes_on_in_the_same_sink(spark):
    src, sink = session.scratch_path(spark, "in"), session.scratch_path(spark, "out")
    for k in range(2):
        spark.createDataFrame([(f"{k}", "<p>x</p>")], "article_id string, content string").write.mode("append").parquet(src)
        clean_articles_stream(spark, src, sink).awaitTermination()
        assert spark.read.parquet(sink).count() == k + 1


def test_one_zero(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (1.5,), (None,)], "v double")
    got = {r["value"]: r.cnt for r in multi_value_counts(df, ["v"]).collect()}
    assert got == {"0.0": 2, "1.5": 1, None: 1}


def test_rich_text_is_strict_json(spark):
    rows = [('{"rich_content":{"text":"a\nb \\"q\\"","spans":[]}}',), ('{"rich_content":{"text":"a\\nb","spans":[]}} tail',)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(rich_text("c")).collect()]
    assert got == ['a\nb \\"q\\"', "a\\nb"]  # the fallback, left escaped


def test_equal_rows_without_a_key_are_drawn_one_by_one(spark):
    df = spark.range(20_000).select(F.lit("x").alias("v"), F.lit(None).cast("int").alias("n"))
    assert 850 < sample_to_cap(df, 1000).count() < 1150
    assert sample_to_cap(df, 1000, exact=True).count() == 1000
    assert sample_to_cap(df, 1000).columns == df.columns
    empty = sample_to_cap(df.limit(0), 10, exact=True)
    assert empty.count() == 0 and sample_to_cap(df.limit(5), 10, exact=True).count() == 5
    both = split_train_test(df)
    assert both.count() == 20_000 and 3700 < both.where("split = 'test'").count() < 4300


def test_null_keys_are_drawn_one_by_one(spark):
    df = spark.range(10_000).select("id", F.lit(None).cast("string").alias("k"))
    for fraction in (0.1, 0.6):
        assert abs(sample_fraction(df, fraction, key="k").count() - 10_000 * fraction) < 200
    two = df.withColumn("k2", F.col("k"))
    assert abs(sample_fraction(two, 0.5, key=["k", "k2"]).count() - 5000) < 200


def test_exact_cap_takes_the_smallest_hashes(spark):
    df = spark.range(3000)
    for m in (0, 1, 777, 3000, 5000):
        kept = {r.id for r in sample_to_cap(df, m, key="id", exact=True).collect()}
        assert len(kept) == min(m, 3000)
    u = {r.id: r.u for r in df.select("id", unit_hash(F.col("id").cast("string"), 5).alias("u")).collect()}
    kept = {r.id for r in sample_to_cap(df, 777, key="id", exact=True).collect()}
    assert kept == set(sorted(u, key=lambda i: (u[i], str(i)))[:777])


@pytest.mark.parametrize("child", [None, "part/a"])
def test_plain_day_directories(spark, child):
    root = session.scratch_path(spark, "days")
    suffix = f"/{child}" if child else ""
    for day in ("20240101", "20240102", "20240105"):
        spark.range(2).withColumn("x", F.lit(day)).write.parquet(f"{root}/{day}{suffix}")
    spark.range(0).limit(0).write.parquet(f"{root}/other")
    got = partitions.date_range_scan(root, "20240102", "20240110", column="day", spark=spark, child=child)
    assert sorted((r.day, r.x) for r in got.collect()) == [("20240102",) * 2] * 2 + [("20240105",) * 2] * 2
    assert partitions.date_range_scan(root, "20240103", "20240104", column="day", spark=spark, child=child).count() == 0
    assert partitions.date_range_scan(root, "20240105", "20240101", column="day", spark=spark, child=child).count() == 0
    missing = partitions.date_coverage(root, "20240101", "20240105", column="day", spark=spark, child=child)
    assert sorted(r.dt for r in missing.collect()) == ["20240103", "20240104"]
    assert partitions.date_coverage(root, "20240101", "20240102", "day", spark, child="none").count() == 2


def test_day_column_of_any_name(spark):
    root = session.scratch_path(spark, "named")
    rows = spark.createDataFrame([(1, "20240101"), (2, "20240102"), (3, "20240103")], "v int, day string")
    rows.write.partitionBy("day").parquet(root)
    got = partitions.date_range_scan(root, "20240102", "20240103", column="day", spark=spark)
    assert sorted((r.v, r.day) for r in got.collect()) == [(2, "20240102"), (3, "20240103")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan or "PartitionFilters: [(cast(day" in plan


def test_vocabulary_candidates_that_repeat_count_together(spark):
    old = spark.createDataFrame([("f", 1, "a"), ("f", 2, "b"), ("f", 3, "z")], "feature string, position int, value string")
    new = [("f", "c", 3), ("f", "d", 2), ("f", "d", 2), ("f", "a", 1), ("f", "z", 9)]
    got = vocabulary_merge(old, spark.createDataFrame(new, "feature string, value string, cnt long"))
    assert sorted((r.position, r.value) for r in got.collect()) == [(1, "a"), (2, "d"), (3, "z")]


def test_importance_counts_what_it_skips(spark):
    rows = [(i, float(i % 7) if i % 5 else None, float("nan") if i % 11 == 0 else 1.0, float(i % 2)) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, label double")
    got = {(r.section, r.name): r.value for r in feature_importance(df, ["a", "b"], key="id").collect()}
    skipped = got["skipped", "train"] + got["skipped", "test"]
    assert skipped == sum(i % 5 == 0 or i % 11 == 0 for i in range(300))
    empty = {(r.section, r.name): r.value for r in feature_importance(df.limit(0), ["a", "b"], key="id").collect()}
    assert empty["confusion", "tp"] == 0 and ("importance", "a") not in empty


def test_batches_of_columns_read_the_table_once(spark):
    df = spark.read.parquet(f"{SF_SMALL}/orders.parquet")
    cols = ["o_orderstatus", "o_orderpriority", "o_custkey"]
    parts = multi_value_counts(df, cols, batch_size=2)
    assert parts._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert sorted(map(str, parts.collect())) == sorted(map(str, multi_value_counts(df, cols).collect()))


def test_vocabulary_merge_plan_has_no_broadcast(spark):
    df = queries()["vocabulary_merge"](spark, SF_SMALL)
    df.collect()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "ResolvedHint" not in plan and "hint" not in plan.lower()
    assert plan.count("Window") < 12


def test_feature_map_refuses_unknown_arguments(spark):
    with pytest.raises(TypeError):
        feature_map(spark.range(3), sparse=["id"], min_shere=0.1)
