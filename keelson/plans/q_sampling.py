"""Queries: balancing, capped sampling, splitting, shuffling and the training-set writers (E, F,
A writers). Key = ``event_id``; the oracles recompute the same md5 fractions in DuckDB."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keelson.functions.sampling import unit_hash, unit_hash_sql
from keelson.operators import sampling as E
from keelson.plans.catalog import register
from keelson.plans.oracle_views import with_views
from keelson.plans.views import feed, table
from keelson.session import scratch_path
from keelson.sources.sinks import footer_statistics, write_all, write_train_test

FEED = with_views("feed")
KEY = "event_id"
_KEY_SQL = "CAST(event_id AS VARCHAR)"


def _u(seed) -> str:
    return unit_hash_sql(_KEY_SQL, seed)


def _dbl(x: float) -> str:
    return f"CAST('{float(x)!r}' AS DOUBLE)"


def _fractions_sql(pos: str, neg: str, rate) -> str:
    """SQL select list of ``_neg_frac, _pos_frac`` (same arithmetic as ``_binary_fractions``)."""
    t = _dbl(float(rate[0]) / float(rate[1]))
    r = f"(CAST({neg} AS DOUBLE) / CAST({pos} AS DOUBLE))"
    empty = f"({pos} = 0 OR {neg} = 0)"
    neg_take = f"floor(CAST({neg} AS DOUBLE) * ({t} / {r})) / CAST({neg} AS DOUBLE)"
    pos_take = f"floor(CAST({pos} AS DOUBLE) * ({r} / {t})) / CAST({pos} AS DOUBLE)"
    one, zero = _dbl(1.0), _dbl(0.0)
    return (
        f"CASE WHEN {empty} THEN {zero} WHEN {r} > {t} THEN {neg_take} ELSE {one} END AS _neg_frac, "
        f"CASE WHEN {empty} THEN {zero} WHEN {r} < {t} THEN {pos_take} ELSE {one} END AS _pos_frac"
    )


_COUNTS = "count(CASE WHEN label = 1 THEN 1 END) AS _pos, count(CASE WHEN label = 0 THEN 1 END) AS _neg"
_KEEP = f"((label = 1 AND {_u(E.SAMPLE_SEED)} < _pos_frac) OR (label = 0 AND {_u(E.SAMPLE_SEED)} < _neg_frac))"


def _ratio_sql(src: str, rate) -> str:
    """Rows of view ``src`` balanced to ``rate`` (a subquery)."""
    return (
        f"(SELECT s.* FROM {src} s CROSS JOIN "
        f"(SELECT {_fractions_sql('_pos', '_neg', rate)} FROM (SELECT {_COUNTS} FROM {src})) fr WHERE {_KEEP})"
    )


def _cap_sql(src: str, max_n: int) -> str:
    frac = f"CAST({max_n} AS DOUBLE) / CAST(n AS DOUBLE)"
    return (
        f"(SELECT s.* FROM {src} s CROSS JOIN (SELECT count(*) AS n FROM {src}) c "
        f"WHERE c.n <= {max_n} OR {_u(E.CAP_SEED)} < {frac})"
    )


# --- E1 -------------------------------------------------------------------------------------
_MINORITY_SQL = (
    FEED
    + f""", c AS (SELECT user_class, count(*) AS cnt FROM feed WHERE user_class IS NOT NULL GROUP BY user_class),
b AS (SELECT user_class AS base, cnt AS mn FROM c ORDER BY cnt, user_class LIMIT 1)
SELECT f.* FROM feed f JOIN c ON f.user_class = c.user_class CROSS JOIN b
WHERE f.user_class = b.base OR {_u(E.SAMPLE_SEED)} < CAST(b.mn AS DOUBLE) / CAST(c.cnt AS DOUBLE)
"""
)


@register("balance_to_minority", _MINORITY_SQL)
def q_balance_to_minority(spark, sf_dir):
    return E.balance_to_minority(feed(spark, sf_dir), "user_class", key=KEY)


_LINES = ["l_orderkey", "l_linenumber", "l_partkey"]
_LINE_KEY = "CAST(l_orderkey AS VARCHAR) || chr(1) || CAST(l_linenumber AS VARCHAR)"


@register(
    "balance_to_minority_many",
    f"""WITH c AS (SELECT l_partkey, count(*) AS cnt FROM lineitem WHERE l_partkey IS NOT NULL GROUP BY l_partkey),
b AS (SELECT l_partkey AS base, cnt AS mn FROM c ORDER BY cnt, l_partkey LIMIT 1)
SELECT {", ".join("l." + x for x in _LINES)} FROM lineitem l JOIN c ON l.l_partkey = c.l_partkey CROSS JOIN b
WHERE l.l_partkey = b.base OR {unit_hash_sql(_LINE_KEY, E.SAMPLE_SEED)} < CAST(b.mn AS DOUBLE) / CAST(c.cnt AS DOUBLE)
""",
)
def q_balance_to_minority_many(spark, sf_dir):
    """Thousands of classes: one for each ordered part."""
    lines = table(spark, sf_dir, "lineitem").select(*_LINES)
    return E.balance_to_minority(lines, "l_partkey", key=["l_orderkey", "l_linenumber"])


# --- E2 / E3 / E4 ---------------------------------------------------------------------------
@register("balance_to_ratio", FEED + "SELECT * FROM " + _ratio_sql("feed", (2, 1)))
def q_balance_to_ratio(spark, sf_dir):
    return E.balance_to_ratio(feed(spark, sf_dir), (2, 1), key=KEY)


_FRAC_SQL = (
    FEED
    + f"SELECT * FROM feed WHERE (label = 1 AND {_u(E.SAMPLE_SEED)} < {_dbl(0.9)}) "
    f"OR (label = 0 AND {_u(E.SAMPLE_SEED)} < {_dbl(0.3)})"
)


@register("balance_by_fractions", _FRAC_SQL)
def q_balance_by_fractions(spark, sf_dir):
    return E.balance_by_fractions(feed(spark, sf_dir), (0.3, 0.9), key=KEY)


@register("sample_to_cap", FEED + "SELECT * FROM " + _cap_sql("feed", 4000))
def q_sample_to_cap(spark, sf_dir):
    return E.sample_to_cap(feed(spark, sf_dir), 4000, key=KEY)


@register(
    "sample_to_cap_exact",
    FEED + f"SELECT * FROM feed QUALIFY row_number() OVER (ORDER BY {_u(E.CAP_SEED)}, {_KEY_SQL}) <= 4000",
)
def q_sample_to_cap_exact(spark, sf_dir):
    return E.sample_to_cap(feed(spark, sf_dir), 4000, key=KEY, exact=True)


_FLAG_JSON = """'{"l_returnflag":"' || l_returnflag || '","l_linestatus":"' || l_linestatus || '"}'"""
_COPY_KEY = f"{_FLAG_JSON} || ':' || CAST(copy AS VARCHAR)"


@register(
    "sample_to_cap_keyless",
    f"""SELECT l_returnflag, l_linestatus
FROM (SELECT l_returnflag, l_linestatus, row_number() OVER (PARTITION BY l_returnflag, l_linestatus) AS copy,
             count(*) OVER () AS n FROM lineitem)
WHERE n <= 5000 OR {unit_hash_sql(_COPY_KEY, E.CAP_SEED)} < CAST(5000 AS DOUBLE) / CAST(n AS DOUBLE)
""",
)
def q_sample_to_cap_keyless(spark, sf_dir):
    """Few different rows with many copies each: copies are drawn one by one."""
    return E.sample_to_cap(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus"), 5000)


_DID_KEY = "coalesce(CAST(did AS VARCHAR), '{\"event_id\":' || CAST(event_id AS VARCHAR) || '}')"


@register(
    "sample_to_cap_null_keys",
    FEED
    + f"""SELECT event_id, did FROM (SELECT event_id, did, count(*) OVER () AS n FROM feed)
WHERE n <= 4000 OR {unit_hash_sql(_DID_KEY, E.CAP_SEED)} < CAST(4000 AS DOUBLE) / CAST(n AS DOUBLE)""",
)
def q_sample_to_cap_null_keys(spark, sf_dir):
    """By entity: its rows share one fate, rows without one are drawn one by one."""
    return E.sample_to_cap(feed(spark, sf_dir).select("event_id", "did"), 4000, key="did")


# --- E5 / E6 --------------------------------------------------------------------------------
_BTS = FEED + ", bal AS " + _ratio_sql("feed", (2, 1)) + "\n"


@register("balance_then_sample", _BTS + "SELECT * FROM " + _cap_sql("bal", 2000))
def q_balance_then_sample(spark, sf_dir):
    return E.balance_then_sample(feed(spark, sf_dir), balance="balance", rate=(2, 1), max_n=2000, key=KEY)


@register("balance_unbalanced", FEED + "SELECT * FROM feed")
def q_balance_unbalanced(spark, sf_dir):
    """The default mode: rows pass whatever their label, null included."""
    return E.balance_then_sample(feed(spark, sf_dir), key=KEY)


_SPLIT_BASE = FEED + ", bal AS " + _ratio_sql("feed", (1, 1)) + ", capped AS " + _cap_sql("bal", 3000) + "\n"
_SPLIT_COL = f"CASE WHEN {_u(E.SPLIT_SEED)} < {_dbl(0.8 / 1.0)} THEN 'train' ELSE 'test' END"


@register("split_train_test", _SPLIT_BASE + f"SELECT *, {_SPLIT_COL} AS split FROM capped")
def q_split_train_test(spark, sf_dir):
    return E.split_train_test(
        feed(spark, sf_dir), (0.8, 0.2), key=KEY, balance="balance", rate=(1, 1), max_n=3000
    )


# --- E7 / E8 --------------------------------------------------------------------------------
_EVENTS = ["purchase", "click", "error"]
_IN = ", ".join(f"'{e}'" for e in _EVENTS)
_PER_EVENT_SQL = (
    FEED
    + f""", sel AS (SELECT * FROM feed WHERE event_name IN ({_IN})),
cnt AS (SELECT event_name, {_COUNTS} FROM sel GROUP BY event_name),
fr AS (
  SELECT event_name,
         CASE WHEN _pos = 0 OR _neg = 0 THEN {_dbl(1.0)} ELSE _neg_frac END AS _neg_frac,
         CASE WHEN _pos = 0 OR _neg = 0 THEN {_dbl(1.0)} ELSE _pos_frac END AS _pos_frac
  FROM (SELECT event_name, _pos, _neg, {_fractions_sql('_pos', '_neg', (1, 1))} FROM cnt))
SELECT s.* FROM sel s JOIN fr ON s.event_name = fr.event_name WHERE {_KEEP}
"""
)


@register("balance_per_event", _PER_EVENT_SQL)
def q_balance_per_event(spark, sf_dir):
    return E.balance_per_event(feed(spark, sf_dir), _EVENTS, (1, 1), key=KEY)


_TOTAL_SQL = (
    FEED
    + ", sel AS (SELECT * FROM feed WHERE event_name IN ('purchase', 'click'))\nSELECT * FROM "
    + _ratio_sql("sel", (3, 1))
)


@register("balance_total", _TOTAL_SQL)
def q_balance_total(spark, sf_dir):
    return E.balance_total(feed(spark, sf_dir), ["purchase", "click"], (3, 1), key=KEY)


# --- F --------------------------------------------------------------------------------------
@register("shuffle_rows", FEED + "SELECT * FROM feed")
def q_shuffle_rows(spark, sf_dir):
    return E.shuffle_rows(feed(spark, sf_dir), key=KEY)


# --- writers (write, read back, count) ------------------------------------------------------
@register(
    "write_train_test",
    _SPLIT_BASE + f"SELECT split, count(*) AS n_rows FROM (SELECT {_SPLIT_COL} AS split FROM capped) GROUP BY split",
)
def q_write_train_test(spark, sf_dir):
    base = scratch_path(spark, "feed_split")
    res = write_train_test(
        feed(spark, sf_dir), base, (0.8, 0.2), key=KEY, balance="balance", rate=(1, 1), max_n=3000
    )
    back = spark.read.parquet(base)
    return back.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows")) if res else back


@register("write_all", _BTS + "SELECT count(*) AS n_rows FROM " + _cap_sql("bal", 2000))
def q_write_all(spark, sf_dir):
    base = scratch_path(spark, "feed")
    path = write_all(feed(spark, sf_dir), base, key=KEY, balance="balance", rate=(2, 1), max_n=2000)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))


_BAL = FEED + ", bal AS " + _ratio_sql("feed", (1, 1)) + "\n"


@register(
    "write_train_test_whole",
    _BAL + f"SELECT split, count(*) AS n_rows FROM (SELECT {_SPLIT_COL} AS split FROM bal) GROUP BY split",
)
def q_write_train_test_whole(spark, sf_dir):
    base = scratch_path(spark, "feed_split")
    write_train_test(feed(spark, sf_dir), base, (0.8, 0.2), key=KEY, balance="balance")
    return spark.read.parquet(base).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@register("write_all_whole", _BAL + "SELECT count(*) AS n_rows FROM bal")
def q_write_all_whole(spark, sf_dir):
    path = write_all(feed(spark, sf_dir), scratch_path(spark, "feed"), key=KEY, balance="balance")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"))


_REPORT_SQL = (
    _SPLIT_BASE
    + f""", sets AS (SELECT *, {_SPLIT_COL} AS split FROM capped),
rep AS (SELECT split, count(*) AS n_rows, count(CASE WHEN label = 1 THEN 1 END) AS positives, count(CASE WHEN label = 0 THEN 1 END) AS negatives,
               CAST(count(CASE WHEN label = 1 THEN 1 END) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS label_rate,
               min(error_code % 7) AS min_len, max(error_code % 7) AS max_len, min(event_id) AS min_id, max(event_id) AS max_id
        FROM sets GROUP BY split)
SELECT layout, rep.*, n_rows AS stored_rows FROM rep, (VALUES ('partitioned'), ('two_paths')) AS l(layout)"""
)


@register("write_train_test_report", _REPORT_SQL)
def q_write_train_test_report(spark, sf_dir):
    """Both layouts: what was observed while writing, and what the written footers state."""
    rows = feed(spark, sf_dir).withColumn("lengths", F.array_repeat(F.lit(1), F.col("error_code") % 7))
    out = []
    for layout in ("partitioned", "two_paths"):
        res = write_train_test(
            rows, scratch_path(spark, "report"), (0.8, 0.2), layout, key=KEY, length_column="lengths", verify=True, balance="balance", rate=(1, 1), max_n=3000
        )
        for r in res["report"]:
            stored = footer_statistics(spark, res["paths"][r["split"]], [KEY])
            seen = [r[c] for c in ("split", "rows", "positives", "negatives", "label_rate", "min_len", "max_len")]
            out.append((layout, *seen, stored[f"min_{KEY}"], stored[f"max_{KEY}"], stored["rows"]))
    names = "layout string, split string, n_rows long, positives long, negatives long, label_rate double, min_len int, max_len int"
    return spark.createDataFrame(out, names + ", min_id long, max_id long, stored_rows long")


@register(
    "shuffle_rows_stored",
    FEED + "SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS out_of_order, CAST(0 AS BIGINT) AS overlapping FROM feed",
)
def q_shuffle_rows_stored(spark, sf_dir):
    """The shuffled rows written to files: within a file hashes rise, and files don't overlap."""
    path = scratch_path(spark, "shuffled")
    E.shuffle_rows(feed(spark, sf_dir).select(KEY), key=KEY).write.parquet(path)
    rows = spark.read.parquet(path).select(
        unit_hash(F.col(KEY).cast("string"), E.SHUFFLE_SEED).alias("u"),
        F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"),
    )
    # Neighbours only: a file's slice of the order is one task's share of the range shuffle.
    before = F.lag("u").over(Window.partitionBy("file").orderBy("at"))
    checked = rows.withColumn("down", (F.col("u") < before).cast("long"))
    files = checked.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"), F.sum("down").alias("down"), F.min("u").alias("lo"), F.max("u").alias("hi")
    )
    over = files.withColumn("over", (F.col("lo") < F.lag("hi").over(Window.orderBy("lo", "hi"))).cast("long"))
    zero = F.lit(0).cast("long")
    return over.agg(
        F.coalesce(F.sum("n"), zero).alias("n_rows"),
        F.coalesce(F.sum("down"), zero).alias("out_of_order"),
        F.coalesce(F.sum("over"), zero).alias("overlapping"),
    )
