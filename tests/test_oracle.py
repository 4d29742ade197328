"""Every registered query against its DuckDB oracle at sf0.001 (the driver's gate runs sf0.01)."""

import pytest

from conftest import SF_SMALL
from keelson.plans.catalog import oracle_sql, queries
from tools.oracle_check import compare

ORACLES = oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, duck, name):
    got = queries()[name](spark, SF_SMALL).toArrow()
    want = duck.sql(ORACLES[name]).to_arrow_table()
    status, detail = compare(got, want)
    assert status == "EXACT", f"{name}: {status} {detail}"
    assert [f.name for f in sorted(got.schema, key=lambda f: f.name)] == sorted(want.schema.names)


@pytest.mark.parametrize("name", sorted(set(queries()) - set(ORACLES)))
def test_rows_only_queries_run(spark, name):
    assert queries()[name](spark, SF_SMALL).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
