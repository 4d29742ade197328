"""Queries: decision-tree feature importance (I) on lineitem numerics, label = return flag R.
Model fitting is not SQL: the reports have no oracle (rows-only check). What SQL can state of them, the test rows per
label, ranks, the sum of the importances and the rows skipped, is checked by the ``*_totals`` queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions.sampling import unit_hash_sql
from keelson.operators import importance as I
from keelson.operators import sampling as E
from keelson.plans.catalog import register
from keelson.plans.views import DENSE_COLUMNS, table


def _labelled(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        *DENSE_COLUMNS,
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("line_id"),
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
    )


@register("feature_importance")
def q_feature_importance(spark, sf_dir):
    return I.feature_importance(_labelled(spark, sf_dir), DENSE_COLUMNS, "label", key="line_id")


@register("importance_analysis")
def q_importance_analysis(spark, sf_dir):
    return I.importance_analysis(_labelled(spark, sf_dir), DENSE_COLUMNS, "label", rate=(1, 1), key="line_id")


def _totals(report):
    value = lambda section, name: F.sum(F.when((F.col("section") == section) & (F.col("name") == name), F.col("value")))
    found = F.col("section") == "importance"
    return report.agg(
        (value("confusion", "tp") + value("confusion", "fn")).cast("long").alias("test_positive"),
        (value("confusion", "fp") + value("confusion", "tn")).cast("long").alias("test_negative"),
        value("skipped", "train").cast("long").alias("skipped_train"),
        value("skipped", "test").cast("long").alias("skipped_test"),
        F.round(F.sum(F.when(found, F.col("value"))), 6).alias("importance_sum"),
        F.concat_ws(",", F.array_sort(F.collect_list(F.when(found, F.col("rank"))))).alias("ranks"),
    )


_LINE_ID = "CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)"
_IS_R = "l_returnflag = 'R'"
_USABLE = " AND ".join(f"{c} IS NOT NULL AND NOT isnan(CAST({c} AS DOUBLE))" for c in DENSE_COLUMNS)


def _totals_sql(rows: str) -> str:
    test = f"{unit_hash_sql('line_id', E.SPLIT_SEED)} >= CAST('0.8' AS DOUBLE)"
    return f"""WITH lines AS (SELECT {_LINE_ID} AS line_id, CAST({_IS_R} AS INTEGER) AS label, {_USABLE} AS usable
  FROM lineitem WHERE l_returnflag IS NOT NULL),
counts AS (SELECT sum(label) AS p, count(*) - sum(label) AS n FROM lines),
part AS ({rows})
SELECT count(*) FILTER (WHERE {test} AND usable AND label = 1) AS test_positive,
       count(*) FILTER (WHERE {test} AND usable AND label = 0) AS test_negative,
       count(*) FILTER (WHERE NOT ({test}) AND NOT usable) AS skipped_train,
       count(*) FILTER (WHERE {test} AND NOT usable) AS skipped_test,
       CAST(1 AS DOUBLE) AS importance_sum, '{",".join(str(i + 1) for i in range(len(DENSE_COLUMNS)))}' AS ranks
FROM part"""


_BALANCED = f"""SELECT lines.* FROM lines CROSS JOIN counts
  WHERE (label = 1 AND (p <= n OR {unit_hash_sql("line_id", E.SAMPLE_SEED)} < floor(CAST(p AS DOUBLE) * ((CAST(n AS DOUBLE) / CAST(p AS DOUBLE)) / CAST(1 AS DOUBLE))) / CAST(p AS DOUBLE)))
     OR (label = 0 AND (n <= p OR {unit_hash_sql("line_id", E.SAMPLE_SEED)} < floor(CAST(n AS DOUBLE) * (CAST(1 AS DOUBLE) / (CAST(n AS DOUBLE) / CAST(p AS DOUBLE)))) / CAST(n AS DOUBLE)))"""


@register("feature_importance_totals", _totals_sql("SELECT * FROM lines"))
def q_feature_importance_totals(spark, sf_dir):
    return _totals(q_feature_importance(spark, sf_dir))


@register("importance_analysis_totals", _totals_sql(_BALANCED))
def q_importance_analysis_totals(spark, sf_dir):
    return _totals(I.importance_analysis(_labelled(spark, sf_dir), DENSE_COLUMNS, "label", rate=(1, 1), max_n=None, key="line_id"))


_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, CAST({_IS_R} AS BIGINT) AS label FROM lineitem WHERE l_returnflag IS NOT NULL" for c in DENSE_COLUMNS
)


@register(
    "feature_split_gains",
    f"""WITH per AS (SELECT feature, value, count(*) AS cnt, CAST(sum(label) AS BIGINT) AS pos FROM ({_LONG})
             WHERE value IS NOT NULL AND NOT isnan(value) GROUP BY feature, value),
run AS (SELECT feature, value, CAST(sum(cnt) OVER up AS DOUBLE) AS a, CAST(sum(pos) OVER up AS DOUBLE) AS p,
               CAST(sum(cnt) OVER (PARTITION BY feature) AS DOUBLE) AS n, CAST(sum(pos) OVER (PARTITION BY feature) AS DOUBLE) AS m
        FROM per WINDOW up AS (PARTITION BY feature ORDER BY value)),
cuts AS (SELECT *, n - a AS b, m - p AS q FROM run WHERE a < n),
gains AS (SELECT feature, value, a, b,
                 ((p * p + (a - p) * (a - p)) / a + (q * q + (b - q) * (b - q)) / b) / n - (m * m + (n - m) * (n - m)) / (n * n) AS gain FROM cuts),
top AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY gain DESC, value) AS r FROM gains)
SELECT feature, value AS threshold, round(gain, 12) AS gain, CAST(a AS BIGINT) AS n_left, CAST(b AS BIGINT) AS n_right FROM top WHERE r = 1""",
)
def q_feature_split_gains(spark, sf_dir):
    return I.split_gains(_labelled(spark, sf_dir), DENSE_COLUMNS).withColumn("gain", F.round("gain", 12))
