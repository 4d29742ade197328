"""Streaming (stateless operators over a file stream) and the Parquet sinks, in scratch folders
under the session's checkpoint folder."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from keelson.operators.text import clean_articles
from keelson.plans.views import articles, feed
from keelson.session import scratch_path
from keelson.sources import partitions as P
from keelson.sources.sinks import read_feature_map, write_feature_map, write_train_test
from keelson.streaming.stateless import clean_articles_stream


def test_clean_articles_stream_equals_batch(spark):
    src = scratch_path(spark, "articles-src")
    sink = scratch_path(spark, "articles-sink")
    arts = articles(spark, SF_SMALL)
    # two batches of input files
    arts.where(F.col("article_id").startswith("d")).write.parquet(f"{src}/part=1")
    arts.where(F.col("article_id").startswith("p")).write.parquet(f"{src}/part=2")
    q = clean_articles_stream(spark, f"{src}/*", sink, max_files_per_trigger=1)
    q.awaitTermination(300)
    got = spark.read.parquet(sink)
    want = clean_articles(arts)
    assert got.count() == want.count()
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_write_train_test_layouts(spark):
    f = feed(spark, SF_SMALL)
    base = scratch_path(spark, "tt")
    res = write_train_test(f, base, layout="partitioned", key="event_id", balance="balance", rate=(1, 1), max_n=500)
    back = spark.read.parquet(base)
    counts = {r.split: r["count"] for r in back.groupBy("split").count().collect()}
    assert sum(counts.values()) == res["metrics"]["rows"]
    assert counts["train"] == res["metrics"]["rows_train"]
    base2 = scratch_path(spark, "tt2")
    res2 = write_train_test(f, base2, layout="two_paths", key="event_id", balance="balance", rate=(1, 1), max_n=500)
    n_train = spark.read.parquet(res2["paths"]["train"]).count()
    n_test = spark.read.parquet(res2["paths"]["test"]).count()
    # the hash split is deterministic: both layouts hold the same rows
    assert (n_train, n_test) == (counts["train"], counts["test"])


def test_feature_map_roundtrip_and_errorifexists(spark):
    fmap = spark.createDataFrame([("f", "sparse", 1, "a")], "feature string, kind string, position long, value string")
    path = scratch_path(spark, "fmap")
    write_feature_map(fmap, path)
    assert read_feature_map(spark, path).collect() == fmap.collect()
    try:
        write_feature_map(fmap, path)
        raised = False
    except Exception:  # noqa: BLE001
        raised = True
    assert raised


def test_partitioned_range_scan_prunes_and_coverage(spark):
    root = scratch_path(spark, "by_day")
    feed(spark, SF_SMALL).write.partitionBy("dt").parquet(root)
    scan = P.date_range_scan(root, "20240105", "20240107", spark=spark)
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "PartitionFilters: []" not in plan
    n = scan.count()
    assert n == feed(spark, SF_SMALL).where(F.col("dt").between("20240105", "20240107")).count()
    missing = [r.dt for r in P.date_coverage(root, "20231231", "20240102", spark=spark).collect()]
    assert missing == ["20231231"]
    present = {r.dt: r.present for r in P.partition_present(root, ["20240101", "20240201"], spark=spark).collect()}
    assert present == {"20240101": True, "20240201": False}


def test_clear_scratch_removes_this_applications_tables(spark):
    from keelson.session import clear_scratch, materialize, scratch_root

    from keelson.session import checkpoint_dir

    assert checkpoint_dir(spark) == checkpoint_dir(spark)  # stable across calls
    t = materialize(spark.range(5), "probe")
    assert t.count() == 5
    root = scratch_root(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert fs.exists(path)  # the table was written under this root
    clear_scratch(spark)
    assert not fs.exists(path)


def test_write_train_test_reports_input_length(spark):
    f = feed(spark, SF_SMALL).withColumn("input_data", F.array(F.col("value"), F.col("predict")))
    res = write_train_test(f, scratch_path(spark, "len"), key="event_id", length_column="input_data", mode="none")
    assert res["metrics"]["min_len"] == 2 and res["metrics"]["max_len"] == 2


def test_listed_days_skip_empty_partition_directories(spark):
    root = scratch_path(spark, "days")
    spark.createDataFrame([("20240101", 1), ("20240102", 2)], "dt string, v int").write.partitionBy("dt").parquet(root)
    jvm = spark.sparkContext._jvm
    fs_path = jvm.org.apache.hadoop.fs.Path(f"{root}/dt=20240103")
    fs = fs_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(fs_path)  # an empty day directory
    fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/dt=20240103/_SUCCESS")).close()  # marker only
    assert P.listed_days(spark, root) == ["20240101", "20240102"]
    missing = [r.dt for r in P.date_coverage(root, "20240101", "20240103", spark=spark).collect()]
    assert missing == ["20240103"]


def test_days_of_other_schemas_and_layouts(spark):
    root = scratch_path(spark, "mixed")
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    frame([(1, 10)], "id int, a int").write.parquet(f"{root}/20240101")
    frame([(2, 20, "x")], "id int, a int, b string").write.parquet(f"{root}/20240102")
    frame([(3, 1 << 40)], "id long, a long").write.parquet(f"{root}/dt=20240102")
    frame([(4, 0.5)], "id int, a double").write.parquet(f"{root}/dt=20240103")
    frame([(5, "t")], "id int, a string").write.parquet(f"{root}/20240104")
    got = P.date_range_scan(root, "20240101", "20240103", spark=spark)
    assert dict(got.dtypes) == {"id": "bigint", "a": "double", "b": "string", "dt": "string"}
    rows = sorted((r.id, r.a, r.b, r.dt) for r in got.collect())
    assert rows == [(1, 10.0, None, "20240101"), (2, 20.0, "x", "20240102"), (3, 2.0**40, None, "20240102"), (4, 0.5, None, "20240103")]
    text = P.date_range_scan(root, "20240101", "20240104", spark=spark)
    assert dict(text.dtypes)["a"] == "string" and text.count() == 5
    assert P.listed_days(spark, root) == ["20240101", "20240102", "20240103", "20240104"]
    assert P.listed_days(spark, root, start="20240102", end="20240103") == ["20240102", "20240103"]
    # Columns that only later days have, in one layout: pruned by partition.
    root = scratch_path(spark, "grown")
    frame([(1,)], "id int").write.parquet(f"{root}/dt=20240101")
    frame([(2, "y")], "id int, b string").write.parquet(f"{root}/dt=20240102")
    got = P.date_range_scan(root, "20240101", "20240102", spark=spark)
    assert sorted((r.id, r.b, r.dt) for r in got.collect()) == [(1, None, "20240101"), (2, "y", "20240102")]
    assert got.where("dt = '20240102'")._jdf.queryExecution().executedPlan().toString().count("PartitionFilters: [") == 1


def test_days_of_a_catalog_table(spark):
    path = scratch_path(spark, "cat")
    name = "days_" + path.split("/")[-2]
    df = spark.createDataFrame([(1, "20240101"), (2, "20240103")], "v int, dt string")
    df.write.partitionBy("dt").option("path", path).saveAsTable(name)
    assert [r.dt for r in P.date_coverage(name, "20240101", "20240103", spark=spark).collect()] == ["20240102"]
    assert [r.v for r in P.date_range_scan(name, "20240102", "20240105", spark=spark).collect()] == [2]
    present = {r.dt: r.present for r in P.partition_present(name, ["20240103", "20240104"], spark=spark).collect()}
    assert present == {"20240103": True, "20240104": False}
    assert P.partition_present(name, [], spark=spark).count() == 0
    plain = name + "_plain"
    df.write.option("path", path + "_plain").saveAsTable(plain)
    assert [r.dt for r in P.date_coverage(plain, "20240101", "20240103", spark=spark).collect()] == ["20240102"]


def test_many_days_are_listed_in_a_few_calls(spark, monkeypatch):
    from py4j.java_gateway import GatewayClient

    root = scratch_path(spark, "many")
    days = [r.d for r in spark.range(400).select(F.date_format(F.expr("date_add(date'2020-01-01', cast(id as int))"), "yyyyMMdd").alias("d")).collect()]
    spark.createDataFrame([(d, 1) for d in days[:40]], "dt string, v int").repartition(1).write.partitionBy("dt").parquet(root)
    jvm = spark.sparkContext._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for d in days[40:]:
        fs.mkdirs(jvm.org.apache.hadoop.fs.Path(f"{root}/dt={d}"))
    calls = []
    send = GatewayClient.send_command
    monkeypatch.setattr(GatewayClient, "send_command", lambda self, *a, **k: calls.append(1) or send(self, *a, **k))
    base, folders = P._day_folders(spark, root, "dt", None)
    assert len(folders) == 400 and len(calls) < 60
    monkeypatch.undo()
    assert P.listed_days(spark, root) == days[:40]


def test_reports_of_both_layouts_agree_with_the_written_rows(spark):
    from keelson.sources.sinks import footer_statistics

    rows = [(i, [None, 0.0, 1.0, 2.0][i % 4], list(range(i % 5))) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, label double, input_data array<int>")
    for layout in ("partitioned", "two_paths"):
        res = write_train_test(df, scratch_path(spark, layout), layout=layout, key="event_id", length_column="input_data", verify=True, rate=None)
        for r in res["report"]:
            back = spark.read.parquet(res["paths"][r["split"]]).collect()
            labels = [b.label for b in back]
            assert (r["rows"], r["positives"], r["negatives"]) == (len(back), labels.count(1.0), labels.count(0.0))
            assert r["unlabelled"] == len(back) - r["positives"] - r["negatives"] > 0
            assert r["label_rate"] == r["positives"] / (r["positives"] + r["negatives"])
            assert (r["min_len"], r["max_len"]) == (min(len(b.input_data) for b in back), max(len(b.input_data) for b in back))
            stored = footer_statistics(spark, res["paths"][r["split"]], ["event_id"])
            assert stored == {"rows": len(back), "min_event_id": min(b.event_id for b in back), "max_event_id": max(b.event_id for b in back)}
    none = write_train_test(df.limit(0), scratch_path(spark, "none"), key="event_id", verify=True)
    assert [(r["rows"], r["label_rate"]) for r in none["report"]] == [(0, None)] * 2


def test_footer_statistics_read_no_data(spark):
    from keelson.sources import sinks

    path = scratch_path(spark, "footers")
    spark.range(1000).write.parquet(path)
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    plan = own.read.parquet(path).agg(F.count(F.lit(1)), F.min("id"))._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), MIN(id)]" in plan
    assert sinks.footer_statistics(spark, path, ["id"]) == {"rows": 1000, "min_id": 0, "max_id": 999}
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")


def test_typed_vocabularies_tell_texts_and_numbers_apart(spark):
    from keelson.operators.feature_map import sparse_map
    from keelson.operators.vocabulary import vocabulary_refresh

    texts = ["1", "1", "1", '"1"', '"1"', "true", '"true"', "null", None, "1.5", "[1]", '{"a": 1}']
    df = spark.createDataFrame([(t, 1) for t in texts], "t string, n int").select(F.parse_json("t").alias("v"), "n", F.lit("1").alias("s"))
    made = sparse_map(df, ["v", "n", "s"], min_share=0.0, typed=True)
    got = {(r.value, r.value_type): r.cnt for r in made.collect()}
    assert got == {("1", "integer"): 3, ("1", "string"): 2, ("true", "boolean"): 1, ("true", "string"): 1, (None, "null"): 2, ("1.5", "number"): 1, ("[1]", "array"): 1, ('{"a":1}', "object"): 1}
    path = write_feature_map(made, scratch_path(spark, "typed"))
    old = read_feature_map(spark, path).where("value_type in ('string', 'null')").selectExpr("feature", "value", "value_type", "row_number() over (order by position) as position")
    fresh = spark.createDataFrame([("1",), ("1",), ("true",), ("null",)], "t string").select(F.parse_json("t").alias("v"))
    merged = vocabulary_refresh(fresh, ["v"], old)
    # The number 1 and the boolean take the places of the texts; null, last, keeps its own.
    before = sorted((r.position, r.value, r.value_type) for r in old.collect())
    assert [b[1:] for b in before] == [("1", "string"), (None, "null"), ("true", "string")]
    after = sorted((r.position, r.value, r.value_type) for r in merged.collect())
    assert after == [(1, "1", "integer"), (2, None, "null"), (3, "true", "string")]
