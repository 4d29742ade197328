"""Queries: outcome funnel (D6) and per-code funnel (D7) on the feed, entity = session."""

from __future__ import annotations

from keelson.operators.outcomes import outcome_funnel, outcome_funnel_by_code
from keelson.plans.catalog import register
from keelson.plans.oracle_views import with_views
from keelson.plans.views import feed, table

_EC = """,
ec AS (SELECT session_id, error_code, count(*) AS n FROM feed GROUP BY session_id, error_code),
ent AS (
  SELECT session_id,
         max(CASE WHEN error_code = 0 THEN 1 ELSE 0 END) AS has_valid,
         sum(CASE WHEN error_code = 0 THEN n ELSE 0 END) AS v,
         sum(CASE WHEN error_code > 0 THEN n ELSE 0 END) AS e
  FROM ec GROUP BY session_id),
tot AS (SELECT (SELECT count(*) FROM feed) AS total_rows, (SELECT count(*) FROM ent) AS total_entities)
"""


def _share(num: str, den: str) -> str:
    return f"round(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE), 5)"


BY_CODE_SQL = (
    with_views("feed")
    + _EC
    + f"""
SELECT ec.error_code,
       CAST(sum(ec.n) AS BIGINT) AS n_rows,
       {_share('sum(ec.n)', 'max(tot.total_rows)')} AS row_share,
       count(*) AS n_entities,
       {_share('count(*)', 'max(tot.total_entities)')} AS entity_share,
       count(CASE WHEN ent.has_valid = 0 THEN 1 END) AS never_valid_entities,
       {_share('count(CASE WHEN ent.has_valid = 0 THEN 1 END)', 'max(tot.total_entities)')} AS never_valid_share
FROM ec JOIN ent ON ec.session_id IS NOT DISTINCT FROM ent.session_id CROSS JOIN tot
WHERE ec.error_code > 0
GROUP BY ec.error_code
"""
)


@register("outcome_funnel_by_code", BY_CODE_SQL)
def q_outcome_funnel_by_code(spark, sf_dir):
    return outcome_funnel_by_code(feed(spark, sf_dir), entity="session_id", code="error_code")


FUNNEL_SQL = (
    with_views("feed")
    + _EC
    + f""",
pop AS (SELECT count(*) AS population FROM customer),
agg AS (
  SELECT CAST(sum(v) AS BIGINT) AS valid_rows,
         count(CASE WHEN v > 0 THEN 1 END) AS valid_entities,
         CAST(sum(e) AS BIGINT) AS error_rows,
         count(CASE WHEN e > 0 THEN 1 END) AS error_entities,
         count(CASE WHEN e > 0 AND v = 0 THEN 1 END) AS error_only_entities
  FROM ent)
SELECT total_rows, total_entities,
       valid_rows, {_share('valid_rows', 'total_rows')} AS valid_row_share,
       valid_entities, {_share('valid_entities', 'total_entities')} AS valid_entity_share,
       {_share('valid_entities', 'population')} AS valid_population_share,
       error_rows, {_share('error_rows', 'total_rows')} AS error_row_share,
       error_entities, {_share('error_entities', 'total_entities')} AS error_entity_share,
       error_only_entities, {_share('error_only_entities', 'total_entities')} AS error_only_share
FROM agg CROSS JOIN tot CROSS JOIN pop
"""
)


@register("outcome_funnel", FUNNEL_SQL)
def q_outcome_funnel(spark, sf_dir):
    population = table(spark, sf_dir, "customer").select("c_custkey")
    return outcome_funnel(feed(spark, sf_dir), entity="session_id", code="error_code", population=population)
