"""Registry of named queries: one per operator, each with its DuckDB oracle when SQL can say it.

A query is ``fn(spark, sf_dir) -> DataFrame`` over the driver tables (or views Spark derives
from them), so its work grows with the tables. The oracle is a SQL string over the same
tables, aliased to the same column names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _ORACLES[name] = sql
        return fn

    return deco


def _load() -> None:
    # Importing the modules registers their queries.
    from keelson.plans import (  # noqa: F401
        q_counts,
        q_features,
        q_filters,
        q_importance,
        q_outcomes,
        q_sampling,
        q_scoring,
        q_sources,
        q_text,
    )


def queries() -> dict[str, QueryFn]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
