"""Queries: percentiles, dense / sparse feature maps, map summary and checks, feature profile and
vocabulary refresh (D12-D18, H) over lineitem, orders, part and the feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import feature_map as FM
from keelson.operators import quantiles as Q
from keelson.operators import vocabulary as V
from keelson.plans.catalog import register
from keelson.plans.oracle_views import with_views
from keelson.plans.views import DENSE_COLUMNS, SPARSE_FEED_COLUMNS, dense_in, feed, ordered_parts, table, vocab_new, vocab_old

LINE_SPARSE = ["l_returnflag", "l_linestatus", "l_linenumber"]


def _dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _long_sql(src: str, cols) -> str:
    parts = [f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols]
    return "long AS (SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL AND NOT isnan(value))"


def _midpoint_sql(src: str, cols, percentiles, variants=("all", "positive")) -> str:
    """CTEs ending in ``pct(feature, variant, percentile, value)``."""
    lv = []
    if "all" in variants:
        lv.append("SELECT feature, 'all' AS variant, value FROM long")
    if "positive" in variants:
        lv.append("SELECT feature, 'positive' AS variant, value FROM long WHERE value > 0")
    pq = ", ".join(f"({_dbl(p)}, {_dbl(float(p) / 100.0)})" for p in percentiles)
    return (
        _long_sql(src, cols)
        + f""",
lv AS ({' UNION ALL '.join(lv)}),
ranked AS (
  SELECT feature, variant, value,
         row_number() OVER (PARTITION BY feature, variant ORDER BY value) - 1 AS rk,
         count(*) OVER (PARTITION BY feature, variant) AS n
  FROM lv),
pq(percentile, q) AS (VALUES {pq}),
tg AS (
  SELECT feature, variant, n, percentile, v, floor(v) AS fl,
         greatest(least(floor(v), n - 1), 0) AS lo, greatest(least(floor(v) + 1, n - 1), 0) AS hi
  FROM (SELECT g.feature, g.variant, g.n, pq.percentile,
               CAST(g.n - 1 AS DOUBLE) * pq.q AS v
        FROM (SELECT DISTINCT feature, variant, n FROM ranked) g CROSS JOIN pq)),
pct AS (
  SELECT tg.feature, tg.variant, tg.percentile,
         CASE WHEN tg.v = tg.fl THEN a.value ELSE b.value - (b.value - a.value) * {_dbl(0.5)} END AS value
  FROM tg
  JOIN ranked a ON a.feature = tg.feature AND a.variant = tg.variant AND a.rk = tg.lo
  JOIN ranked b ON b.feature = tg.feature AND b.variant = tg.variant AND b.rk = tg.hi)
"""
    )


@register(
    "percentiles_midpoint",
    "WITH " + _midpoint_sql("lineitem", DENSE_COLUMNS, Q.DEFAULT_PERCENTILES) + "SELECT * FROM pct",
)
def q_percentiles_midpoint(spark, sf_dir):
    return Q.percentiles_midpoint(dense_in(spark, sf_dir), DENSE_COLUMNS)


def _dense_exact_sql(src: str, cols) -> str:
    return (
        "WITH "
        + _midpoint_sql(src, cols, (5, 99), variants=("positive",))
        + """, b AS (
  SELECT feature, max(CASE WHEN percentile = 5 THEN value END) AS p5,
         max(CASE WHEN percentile = 99 THEN value END) AS p99
  FROM pct GROUP BY feature)
SELECT feature, 'dense' AS kind, CAST(0 AS DOUBLE) AS min, p99 AS max FROM b WHERE p5 < p99
"""
    )


@register("dense_map_exact", _dense_exact_sql("lineitem", DENSE_COLUMNS))
def q_dense_map_exact(spark, sf_dir):
    return Q.dense_map_exact(dense_in(spark, sf_dir), DENSE_COLUMNS)


_DENSE_APPROX_SQL = (
    "WITH "
    + _long_sql("lineitem", DENSE_COLUMNS)
    + """, b AS (SELECT feature, quantile_disc(value, 0.1) AS lo, quantile_disc(value, 0.95) AS hi
          FROM long GROUP BY feature)
SELECT feature, 'dense' AS kind, CAST(0 AS DOUBLE) AS min, hi AS max FROM b WHERE lo < hi
"""
)


@register("dense_map_approx", _DENSE_APPROX_SQL)
def q_dense_map_approx(spark, sf_dir):
    return Q.dense_map_approx(dense_in(spark, sf_dir), DENSE_COLUMNS, rel_error=0.0)


_SKETCH_ERROR = 0.01


@register(
    "dense_map_sketch",
    "SELECT feature, true AS within FROM (VALUES " + ", ".join(f"('{c}')" for c in DENSE_COLUMNS) + ") AS w(feature)",
)
def q_dense_map_sketch(spark, sf_dir):
    """The default (sketch) path: the 95% bound of each feature has its rank within the sketch's error."""
    rows = dense_in(spark, sf_dir)
    found = Q.dense_map_approx(rows, DENSE_COLUMNS, rel_error=_SKETCH_ERROR)
    bounds = found.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", "max"))).alias("m")).scalar()
    n = F.count(F.lit(1))
    counted = rows.agg(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"),
                    (F.count(F.when(F.col(c) < bounds[c], 1)) / n).alias("below"),
                    (F.count(F.when(F.col(c) <= bounds[c], 1)) / n).alias("upto"),
                )
                for c in DENSE_COLUMNS
            ]
        ).alias("a")
    )
    inside = (F.col("below") <= 0.95 + _SKETCH_ERROR) & (F.col("upto") >= 0.95 - _SKETCH_ERROR)
    return counted.select(F.inline("a")).select("feature", inside.alias("within"))


def _sparse_sql(src: str, cols, min_share=0.001, max_len=100, name="sp") -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, v AS value, count(*) AS cnt FROM (SELECT CAST({c} AS VARCHAR) AS v FROM {src}) "
        f"GROUP BY v"
        for c in cols
    )
    rate = "CAST(c.cnt AS DOUBLE) / CAST(t.n AS DOUBLE)"
    return f"""{name}_counts AS ({counts}),
{name}_kept AS (
  SELECT c.feature, c.value, c.cnt, {rate} AS rate
  FROM {name}_counts c JOIN (SELECT feature, sum(cnt) AS n FROM {name}_counts GROUP BY feature) t
    ON c.feature = t.feature
  WHERE {rate} >= {_dbl(min_share)}),
{name} AS (
  SELECT feature, 'sparse' AS kind, position, value, cnt, rate FROM (
    SELECT *, count(*) OVER (PARTITION BY feature) AS len,
           row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, value ASC NULLS LAST) AS position
    FROM {name}_kept) WHERE len BETWEEN 2 AND {max_len})
"""


@register("sparse_map", with_views("feed") + ", " + _sparse_sql("feed", SPARSE_FEED_COLUMNS) + "SELECT * FROM sp")
def q_sparse_map(spark, sf_dir):
    return FM.sparse_map(feed(spark, sf_dir), SPARSE_FEED_COLUMNS)


_FMAP_CTES = (
    _midpoint_sql("lineitem", DENSE_COLUMNS, (5, 99), variants=("positive",))
    + """, b AS (
  SELECT feature, max(CASE WHEN percentile = 5 THEN value END) AS p5,
         max(CASE WHEN percentile = 99 THEN value END) AS p99
  FROM pct GROUP BY feature),
"""
    + _sparse_sql("lineitem", LINE_SPARSE)
    + """, fmap AS (
  SELECT feature, 'dense' AS kind, CAST(NULL AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS value,
         CAST(NULL AS BIGINT) AS cnt, CAST(NULL AS DOUBLE) AS rate, CAST(0 AS DOUBLE) AS min, p99 AS max
  FROM b WHERE p5 < p99
  UNION ALL
  SELECT feature, kind, position, value, cnt, rate, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM sp)
"""
)


def _line_map(spark, sf_dir):
    return FM.feature_map(table(spark, sf_dir, "lineitem"), DENSE_COLUMNS, LINE_SPARSE, dense_method="exact")


@register("feature_map", "WITH " + _FMAP_CTES + "SELECT * FROM fmap")
def q_feature_map(spark, sf_dir):
    return _line_map(spark, sf_dir)


_SUMMARY_SQL = (
    "WITH "
    + _FMAP_CTES
    + """, per AS (
  SELECT kind, feature, CAST(CASE WHEN kind = 'dense' THEN 1 ELSE count(*) END AS BIGINT) AS width,
         min(min) AS min, max(max) AS max
  FROM fmap GROUP BY kind, feature)
SELECT 'feature' AS level, kind, feature, width, CAST(1 AS BIGINT) AS n_features, min, max FROM per
UNION ALL
SELECT 'kind', kind, NULL, CAST(sum(width) AS BIGINT), count(*), min(min), max(max) FROM per GROUP BY kind
UNION ALL
SELECT 'total', NULL, NULL, CAST(sum(width) AS BIGINT), count(*), min(min), max(max) FROM per
"""
)


@register("feature_map_summary", _SUMMARY_SQL)
def q_feature_map_summary(spark, sf_dir):
    return FM.feature_map_summary(_line_map(spark, sf_dir))


_KEYS = ["l_quantity", "l_returnflag", "l_comment", "l_tax", "l_linenumber"]
_KEYS_SQL = (
    "WITH "
    + _FMAP_CTES
    + ", w(feature) AS (VALUES "
    + ", ".join(f"('{k}')" for k in _KEYS)
    + """)
SELECT w.feature, h.kind IS NOT NULL AS present, h.kind, h.entries
FROM w LEFT JOIN (SELECT feature, min(kind) AS kind, count(*) AS entries FROM fmap GROUP BY feature) h
  ON w.feature = h.feature
"""
)


@register("feature_map_keys_check", _KEYS_SQL)
def q_feature_map_keys_check(spark, sf_dir):
    return FM.feature_map_keys_check(_line_map(spark, sf_dir), _KEYS)


_PROFILE_SPARSE = ["o_orderstatus", "o_orderpriority"]
_PROFILE_DENSE = ["o_totalprice"]
_PROFILE_SQL = (
    "WITH "
    + _midpoint_sql("orders", _PROFILE_DENSE, Q.DEFAULT_PERCENTILES)
    + ", pc AS ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, v AS value, count(*) AS cnt FROM (SELECT CAST({c} AS VARCHAR) AS v FROM orders) "
        f"GROUP BY v"
        for c in _PROFILE_SPARSE
    )
    + """),
pt AS (SELECT feature, sum(cnt) AS n FROM pc GROUP BY feature),
top AS (
  SELECT * FROM (
    SELECT pc.*, pt.n, row_number() OVER (PARTITION BY pc.feature ORDER BY cnt DESC, value ASC NULLS LAST) AS position
    FROM pc JOIN pt ON pc.feature = pt.feature) WHERE position <= 10)
SELECT 'sparse' AS kind, feature, position, value, cnt,
       round(CAST(cnt AS DOUBLE) / CAST(n AS DOUBLE), 5) AS share,
       CAST(NULL AS VARCHAR) AS variant, CAST(NULL AS DOUBLE) AS percentile, CAST(NULL AS DOUBLE) AS stat
FROM top
UNION ALL
SELECT 'dense', feature, NULL, NULL, NULL, NULL, variant, percentile, value FROM pct
"""
)


@register("feature_profile", _PROFILE_SQL)
def q_feature_profile(spark, sf_dir):
    return FM.feature_profile(table(spark, sf_dir, "orders"), _PROFILE_SPARSE, _PROFILE_DENSE)


def _merge_sql(old: str, new: str, typed: bool = False) -> str:
    """With ``typed``, a value is a struct of its text and its type."""
    same = "{a}.feature = {b}.feature AND {a}.value IS NOT DISTINCT FROM {b}.value"
    by = "c.value.value ASC NULLS LAST, c.value.value_type" if typed else "c.value ASC NULLS LAST"
    return f"""old AS (SELECT feature, position, value, max(position) OVER (PARTITION BY feature) AS L FROM {old}),
reserved AS (SELECT feature, position, value FROM old WHERE position = L),
slots AS (SELECT feature, position, value FROM old WHERE position < L),
cands AS (SELECT n.feature, n.value, n.cnt FROM {new} n
          WHERE NOT EXISTS (SELECT 1 FROM reserved r WHERE {same.format(a='r', b='n')})),
kept AS (SELECT s.* FROM slots s WHERE EXISTS (SELECT 1 FROM cands c WHERE {same.format(a='c', b='s')})),
gaps AS (SELECT s.*, row_number() OVER (PARTITION BY s.feature ORDER BY s.position) AS r FROM slots s
         WHERE NOT EXISTS (SELECT 1 FROM cands c WHERE {same.format(a='c', b='s')})),
remaining AS (SELECT c.*, row_number() OVER (PARTITION BY c.feature ORDER BY c.cnt DESC, {by}) AS r
              FROM cands c WHERE NOT EXISTS (SELECT 1 FROM slots s WHERE {same.format(a='s', b='c')})),
merged AS (
  SELECT feature, position, value FROM kept
  UNION ALL
  SELECT g.feature, g.position, CASE WHEN m.r IS NOT NULL THEN m.value ELSE g.value END
  FROM gaps g LEFT JOIN remaining m ON g.feature = m.feature AND g.r = m.r
  UNION ALL
  SELECT feature, position, value FROM reserved)
"""


@register(
    "vocabulary_merge",
    with_views("vocab_old", "vocab_new") + ", " + _merge_sql("vocab_old", "vocab_new") + "SELECT * FROM merged",
)
def q_vocabulary_merge(spark, sf_dir):
    return V.vocabulary_merge(vocab_old(spark, sf_dir), vocab_new(spark, sf_dir))


@register(
    "vocabulary_refresh",
    with_views("vocab_old", "vocab_new") + ", " + _merge_sql("vocab_old", "vocab_new") + "SELECT * FROM merged",
)
def q_vocabulary_refresh(spark, sf_dir):
    return V.vocabulary_refresh(ordered_parts(spark, sf_dir), ["p_brand"], vocab_old(spark, sf_dir))


# --- map persistence (write, read back) -----------------------------------------------------
@register(
    "write_feature_map",
    "WITH " + _FMAP_CTES + "SELECT kind, count(*) AS entries FROM fmap GROUP BY kind",
)
def q_write_feature_map(spark, sf_dir):
    from keelson.session import scratch_path
    from keelson.sources.sinks import write_feature_map

    path = write_feature_map(_line_map(spark, sf_dir), scratch_path(spark, "feature_map"))
    return spark.read.parquet(path).groupBy("kind").agg(F.count(F.lit(1)).alias("entries"))


@register("read_feature_map", "WITH " + _FMAP_CTES + "SELECT * FROM fmap")
def q_read_feature_map(spark, sf_dir):
    from keelson.session import scratch_path
    from keelson.sources.sinks import read_feature_map, write_feature_map

    path = write_feature_map(_line_map(spark, sf_dir), scratch_path(spark, "feature_map"))
    return read_feature_map(spark, path)


# --- typed vocabularies: a VARIANT column that holds numbers, texts, booleans and nulls -------
_MIXED_JSON = ["1", '"1"', "true", '"true"', "null", None, "22", '"null"', "false"]


def _mixed_values(spark, sf_dir, where="true"):
    code = F.lit(None).cast("string")
    for i, text in enumerate(_MIXED_JSON):
        code = F.when(F.col("value").cast("long") % len(_MIXED_JSON) == i, F.lit(text)).otherwise(code)
    return feed(spark, sf_dir).where(where).select(F.parse_json(code).alias("mixed"), "event_name", "label", "error_code")


_MIXED_FEATURES = ["mixed", "event_name", "label", "error_code"]
_MIXED_CASE = "CASE " + " ".join(
    f"WHEN CAST(floor(value) AS BIGINT) % {len(_MIXED_JSON)} = {i} THEN " + (f"'{t}'" if t else "NULL") for i, t in enumerate(_MIXED_JSON)
) + " END"
_KIND = """CASE WHEN j IS NULL OR j = 'null' THEN 'null' WHEN j[1] = '"' THEN 'string' WHEN j IN ('true', 'false') THEN 'boolean' ELSE 'integer' END"""
_PLAIN = {"event_name": "string", "label": "number", "error_code": "integer"}


def _typed_counts_sql(name: str, where: str) -> str:
    parts = [f"SELECT 'mixed' AS feature, CASE WHEN j <> 'null' THEN trim(j, '\"') END AS value, {_KIND} AS value_type FROM (SELECT {_MIXED_CASE} AS j FROM feed {where})"]
    for c, kind in _PLAIN.items():
        parts.append(f"SELECT '{c}', CAST({c} AS VARCHAR), CASE WHEN {c} IS NULL THEN 'null' ELSE '{kind}' END FROM feed {where}")
    return f"{name} AS (SELECT feature, value, value_type, count(*) AS cnt FROM ({' UNION ALL '.join(parts)}) GROUP BY feature, value, value_type)"


@register(
    "feature_map_typed",
    with_views("feed")
    + ", "
    + _typed_counts_sql("c", "")
    + """, k AS (SELECT c.*, CAST(cnt AS DOUBLE) / CAST(sum(cnt) OVER (PARTITION BY feature) AS DOUBLE) AS rate FROM c)
SELECT feature, value, value_type, cnt, rate,
       row_number() OVER (PARTITION BY feature ORDER BY cnt DESC, value ASC NULLS LAST, value_type) AS position
FROM (SELECT *, count(*) OVER (PARTITION BY feature) AS len FROM k WHERE rate >= 0.001) WHERE len BETWEEN 2 AND 100""",
)
def q_feature_map_typed(spark, sf_dir):
    """A typed map, written and read back."""
    from keelson.session import scratch_path
    from keelson.sources.sinks import read_feature_map, write_feature_map

    made = FM.feature_map(_mixed_values(spark, sf_dir), sparse=_MIXED_FEATURES, typed=True)
    path = write_feature_map(made, scratch_path(spark, "typed_map"))
    return read_feature_map(spark, path).select("feature", "value", "value_type", "cnt", "rate", "position")


@register(
    "vocabulary_refresh_typed",
    with_views("feed")
    + ", "
    + _typed_counts_sql("c_old", "WHERE event_name = 'view' AND value < 60")
    + ", "
    + _typed_counts_sql("c_new", "")
    + """, vocab_o AS (
  SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY cnt, value ASC NULLS LAST, value_type) AS position,
         {'value': value, 'value_type': value_type} AS value FROM c_old),
vocab_n AS (SELECT feature, {'value': value, 'value_type': value_type} AS value, cnt FROM c_new), """
    + _merge_sql("vocab_o", "vocab_n", typed=True)
    + "SELECT feature, position, value.value AS value, value.value_type AS value_type FROM merged",
)
def q_vocabulary_refresh_typed(spark, sf_dir):
    """A vocabulary of some rows, rarest value first, refreshed by all."""
    from pyspark.sql import Window

    from keelson.operators.counts import multi_value_counts

    rows = _mixed_values(spark, sf_dir)
    seen = _mixed_values(spark, sf_dir, "event_name = 'view' AND value < 60")
    order = Window.partitionBy("feature").orderBy("cnt", F.col("value").asc_nulls_last(), "value_type")
    old = multi_value_counts(seen, _MIXED_FEATURES, typed=True).withColumn("position", F.row_number().over(order).cast("long"))
    return V.vocabulary_refresh(rows, _MIXED_FEATURES, old.drop("cnt"))
