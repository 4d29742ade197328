"""Queries: AUC, threshold confusion and threshold penetration (D19, D20, D8) on the feed."""

from __future__ import annotations

from keelson.operators import thresholds as T
from keelson.plans.catalog import register
from keelson.plans.oracle_views import with_views
from keelson.plans.views import feed, table

FEED = with_views("feed")


def _dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _th_values(ths) -> str:
    return ", ".join(f"({i}, {_dbl(t)})" for i, t in enumerate(ths))


_AUC_SQL = (
    FEED
    + """, g AS (
  SELECT predict, count(CASE WHEN label = 1 THEN 1 END) AS pos, count(CASE WHEN label = 0 THEN 1 END) AS neg
  FROM feed WHERE predict IS NOT NULL AND label IN (0, 1) GROUP BY predict),
c AS (
  SELECT pos, neg,
         coalesce(sum(neg) OVER (ORDER BY predict ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM g)
SELECT round(sum(CAST(pos AS DOUBLE) * (CAST(2 AS DOUBLE) * CAST(below AS DOUBLE) + CAST(neg AS DOUBLE)))
             / (CAST(2 AS DOUBLE) * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)), 4) AS auc,
       CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM c
"""
)


@register("auc", _AUC_SQL)
def q_auc(spark, sf_dir):
    return T.auc(feed(spark, sf_dir), "predict", "label")


def _div(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) = 0 THEN NULL ELSE CAST({a} AS DOUBLE) / CAST({b} AS DOUBLE) END"


_CONF_SQL = (
    FEED
    + f""", th(th_index, threshold) AS (VALUES {_th_values(T.CONFUSION_THRESHOLDS)}),
c AS (
  SELECT th.threshold,
         count(CASE WHEN f.predict > th.threshold AND f.label = 1 THEN 1 END) AS tp,
         count(CASE WHEN f.predict > th.threshold AND f.label = 0 THEN 1 END) AS fp,
         count(CASE WHEN NOT coalesce(f.predict > th.threshold, false) AND f.label = 1 THEN 1 END) AS fn,
         count(CASE WHEN NOT coalesce(f.predict > th.threshold, false) AND f.label = 0 THEN 1 END) AS tn
  FROM feed f CROSS JOIN th WHERE f.label IN (0, 1) GROUP BY th.threshold)
SELECT threshold, tp, fp, fn, tn,
       round({_div('tp + tn', 'tp + fp + fn + tn')}, 4) AS accuracy,
       {_div('tp', 'tp + fp')} AS precision, {_div('tp', 'tp + fn')} AS recall,
       tp + fn AS label_pos, fp + tn AS label_neg, tp + fp AS pred_pos, fn + tn AS pred_neg
FROM c
"""
)


@register("threshold_confusion", _CONF_SQL)
def q_threshold_confusion(spark, sf_dir):
    return T.threshold_confusion(feed(spark, sf_dir), "predict", "label")


def _share(a: str, b: str) -> str:
    return f"round({_div(a, b)}, 5)"


_PEN_SQL = (
    FEED
    + f""", th(th_index, threshold) AS (VALUES {_th_values(T.PENETRATION_THRESHOLDS)}),
ent AS (SELECT did, max(predict) AS m FROM feed GROUP BY did),
r AS (SELECT th.threshold, count(CASE WHEN f.predict >= th.threshold THEN 1 END) AS n_rows, count(*) AS total_rows
      FROM feed f CROSS JOIN th GROUP BY th.threshold),
e AS (SELECT th.threshold, count(CASE WHEN ent.m >= th.threshold THEN 1 END) AS n_entities,
             count(*) AS total_entities
      FROM ent CROSS JOIN th GROUP BY th.threshold),
pop AS (SELECT count(*) AS population FROM customer)
SELECT r.threshold, n_rows, {_share('n_rows', 'total_rows')} AS row_share,
       n_entities, {_share('n_entities', 'total_entities')} AS entity_share,
       {_share('n_entities', 'population')} AS population_share
FROM r JOIN e ON r.threshold = e.threshold CROSS JOIN pop
"""
)


@register("threshold_penetration", _PEN_SQL)
def q_threshold_penetration(spark, sf_dir):
    population = table(spark, sf_dir, "customer").select("c_custkey")
    return T.threshold_penetration(feed(spark, sf_dir), "predict", "did", population)
