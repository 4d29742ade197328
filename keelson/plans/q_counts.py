"""Queries: value counts and reports (D1-D5, D9-D11) on the feed and lineitem."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.operators import counts as C
from keelson.plans.catalog import register
from keelson.plans.oracle_views import with_views
from keelson.plans.views import feed, table

FEED = with_views("feed")


def _share(num: str, den: str) -> str:
    return f"round(CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE), 5)"


@register("value_counts", FEED + "SELECT label, count(*) AS cnt FROM feed GROUP BY label")
def q_value_counts(spark, sf_dir):
    return C.value_counts(feed(spark, sf_dir), "label")


MVC_COLUMNS = ["event_name", "user_class", "label", "enter_app"]

_MVC_SQL = FEED + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS feature, v AS value, count(*) AS cnt FROM (SELECT CAST({c} AS VARCHAR) AS v FROM feed) GROUP BY v"
    for c in MVC_COLUMNS
)


@register("multi_value_counts", _MVC_SQL)
def q_multi_value_counts(spark, sf_dir):
    return C.multi_value_counts(feed(spark, sf_dir), MVC_COLUMNS, batch_size=3)


@register("distinct_entities", FEED + "SELECT count(*) AS n_entities FROM (SELECT DISTINCT did FROM feed)")
def q_distinct_entities(spark, sf_dir):
    return C.distinct_entities(feed(spark, sf_dir), "did")


@register(
    "rows_and_entities",
    FEED + "SELECT count(*) AS n_rows, (SELECT count(*) FROM (SELECT DISTINCT did FROM feed)) AS n_entities FROM feed",
)
def q_rows_and_entities(spark, sf_dir):
    return C.rows_and_entities(feed(spark, sf_dir), "did")


_HIT = "CASE WHEN event_name = 'purchase' THEN 1 ELSE 0 END"
_PEN_SQL = (
    FEED
    + f""", m AS (
  SELECT 'rows' AS measure, count(*) AS total, CAST(sum({_HIT}) AS BIGINT) AS selected FROM feed
  UNION ALL
  SELECT 'did', count(*), CAST(sum(hit) AS BIGINT) FROM (SELECT did, max({_HIT}) AS hit FROM feed GROUP BY did)
  UNION ALL
  SELECT 'session_id', count(*), CAST(sum(hit) AS BIGINT)
  FROM (SELECT session_id, max({_HIT}) AS hit FROM feed GROUP BY session_id))
SELECT measure, total, selected, {_share('selected', 'total')} AS penetration FROM m
"""
)


@register("penetration_by_entity", _PEN_SQL)
def q_penetration_by_entity(spark, sf_dir):
    return C.penetration_by_entity(feed(spark, sf_dir), "event_name", "purchase", ["did", "session_id"])


_LABELS = ["label", "enter_app"]
_ELR_SQL = FEED + "\nUNION ALL\n".join(
    part
    for lab in _LABELS
    for part in (
        f"SELECT 'event' AS scope, event_name, '{lab}' AS label, v AS value, count(*) AS cnt "
        f"FROM (SELECT event_name, CAST({lab} AS VARCHAR) AS v FROM feed) GROUP BY event_name, v",
        f"SELECT 'all' AS scope, CAST(NULL AS VARCHAR) AS event_name, '{lab}' AS label, v AS value, count(*) AS cnt "
        f"FROM (SELECT CAST({lab} AS VARCHAR) AS v FROM feed) GROUP BY v",
    )
)


@register("event_label_rates", _ELR_SQL)
def q_event_label_rates(spark, sf_dir):
    return C.event_label_rates(feed(spark, sf_dir), _LABELS, event="event_name")


# Descriptions of the outcome codes the code report names (our wording of the report labels).
OUTCOME_CODE_NAMES = {
    0: "model inference ok",
    401: "length requirement not met",
    402: "live content, not reranked",
    403: "ad content, not reranked",
    1000: "session exit",
}

_OCR_VALUES = ", ".join(f"({k}, '{v}')" for k, v in OUTCOME_CODE_NAMES.items())
_OCR_SQL = (
    FEED
    + f""", counts AS (SELECT error_code, count(*) AS cnt FROM feed GROUP BY error_code),
lookup(error_code, description) AS (VALUES {_OCR_VALUES}),
tot AS (SELECT sum(cnt) AS total FROM counts)
SELECT c.error_code, l.description, c.cnt, {_share('c.cnt', 'tot.total')} AS share
FROM counts c JOIN lookup l ON c.error_code = l.error_code CROSS JOIN tot
"""
)


@register("outcome_code_report", _OCR_SQL)
def q_outcome_code_report(spark, sf_dir):
    return C.outcome_code_report(feed(spark, sf_dir), "error_code", OUTCOME_CODE_NAMES)


_TOPK_SQL = f"""WITH counts AS (SELECT l_partkey, count(*) AS cnt FROM lineitem GROUP BY l_partkey),
tot AS (SELECT sum(cnt) AS total FROM counts)
SELECT l_partkey, cnt, {_share('cnt', 'total')} AS share
FROM (SELECT * FROM counts ORDER BY cnt DESC, l_partkey ASC NULLS LAST LIMIT 10) CROSS JOIN tot
"""


@register("value_topk", _TOPK_SQL)
def q_value_topk(spark, sf_dir):
    return C.value_topk(table(spark, sf_dir, "lineitem"), "l_partkey", 10)


@register("distinct_values", FEED + "SELECT DISTINCT did FROM feed")
def q_distinct_values(spark, sf_dir):
    return C.distinct_values(feed(spark, sf_dir), "did")


# --- stored sketches: distinct entities and penetration over any range of days -----------------
_RANGES = [("20240103", "20240110"), ("20240101", "20240131"), ("20250101", "20250102")]
_SKETCH_SQL = (
    with_views("feed")
    + "SELECT * FROM ("
    + " UNION ALL ".join(
        f"""SELECT '{a}-{b}' AS days, event_name, count(*) AS n_rows, count(DISTINCT did) + CAST(count(*) > count(did) AS BIGINT) AS exact, true AS within
FROM feed WHERE dt BETWEEN '{a}' AND '{b}' GROUP BY event_name
UNION ALL SELECT '{a}-{b}', NULL, count(*), count(DISTINCT did) + CAST(count(*) > count(did) AS BIGINT), true FROM feed WHERE dt BETWEEN '{a}' AND '{b}'"""
        for a, b in _RANGES
    )
    + ")"
)


@register("distinct_entities_sketched", _SKETCH_SQL)
def q_distinct_entities_sketched(spark, sf_dir):
    """Daily sketches per event, stored; ranges of days per event and over all events, against the exact counts."""
    from functools import reduce

    from keelson.operators import sketches as S
    from keelson.session import materialize

    rows = feed(spark, sf_dir).select("dt", "event_name", "did")
    stored = materialize(S.daily_sketches(rows, "did", by=["event_name"]), "did_sketches")
    every = F.lit(None).cast("string").alias("event_name")
    out = []
    for a, b in _RANGES:
        inside = rows.where(F.col("dt").between(a, b))
        for by, name in ((["event_name"], F.col("event_name")), ([], every)):
            found = S.entities_over(stored, a, b, by).select(name, "n_rows", "n_entities")
            exact = inside.select(*by, "did").distinct().groupBy(*by).agg(F.count(F.lit(1)).alias("exact")).select(name, "exact")
            both = found.join(exact, found["event_name"].eqNullSafe(exact["event_name"])).drop(exact["event_name"])
            near = F.abs(F.col("n_entities") - F.col("exact")) <= F.lit(S.error_bound()) * F.col("exact") + 1
            out.append(both.select(F.lit(f"{a}-{b}").alias("days"), "event_name", "n_rows", "exact", near.alias("within")))
    return reduce(DataFrame.unionByName, out)
