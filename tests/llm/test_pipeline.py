"""The pipeline's stages on their own input, and the SQL twins on the smallest tables."""

import pytest

import corpus_pipeline
from keelson.llm import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_sql_twin(spark, duck, name):
    got = catalog.queries()[name](spark, SF)
    r = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(got.columns)
    show = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v)
    assert sorted(tuple(map(show, x)) for x in got.select(*columns).collect()) == sorted(tuple(map(show, x)) for x in r.fetchall())


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) >= {"doc_id", "piece", "length", "sequence_id", "offset"} and out.count() > 0
    clash = docs.limit(40).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "n_words")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, clash, SF)
        assert kept.columns == clash.columns, name
        assert stage(spark, clash.limit(0), SF).count() == 0, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substrings", "mixing", "packing"]
