"""Queries: day lists, day arithmetic, coverage and range scans (A, K) on the feed's ``dt``."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.functions.dates import date_shift, day_sequence
from keelson.plans.catalog import register
from keelson.plans.oracle_views import with_views
from keelson.plans.views import feed
from keelson.session import scratch_path
from keelson.sources import partitions as P

FEED = with_views("feed")


def _d(col: str) -> str:
    return f"strptime({col}, '%Y%m%d')"


_DATE_LIST_SQL = (
    FEED
    + """SELECT strftime(d, '%Y%m%d') AS dt
FROM (SELECT min(dt) AS a, max(dt) AS b FROM feed) r,
     generate_series(CAST(strptime(a, '%Y%m%d') AS DATE) - INTERVAL 3 DAY,
                     CAST(strptime(b, '%Y%m%d') AS DATE) + INTERVAL 3 DAY, INTERVAL 1 DAY) AS g(d)
"""
)


@register("date_list", _DATE_LIST_SQL)
def q_date_list(spark, sf_dir):
    bounds = feed(spark, sf_dir).agg(F.min("dt").alias("a"), F.max("dt").alias("b"))
    return bounds.select(F.explode(day_sequence(date_shift("a", -3), date_shift("b", 3))).alias("dt"))


_SHIFT_SQL = (
    FEED
    + """SELECT event_id, dt,
       strftime(CAST(strptime(dt, '%Y%m%d') AS DATE) - INTERVAL 45 DAY, '%Y%m%d') AS dt_back,
       strftime(CAST(strptime(dt, '%Y%m%d') AS DATE) + INTERVAL 400 DAY, '%Y%m%d') AS dt_fwd,
       dt AS dt_same
FROM feed"""
)


@register("date_shift", _SHIFT_SQL)
def q_date_shift(spark, sf_dir):
    return feed(spark, sf_dir).select(
        "event_id",
        "dt",
        date_shift("dt", -45).alias("dt_back"),
        date_shift("dt", 400).alias("dt_fwd"),
        date_shift("dt", 0).alias("dt_same"),
    )


COVER_START, COVER_END = "20231230", "20240202"
_COVER_SQL = (
    FEED
    + f"""SELECT strftime(d, '%Y%m%d') AS dt
FROM generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY) AS g(d)
WHERE strftime(d, '%Y%m%d') NOT IN (SELECT DISTINCT dt FROM feed WHERE dt IS NOT NULL)"""
)


@register("date_coverage", _COVER_SQL)
def q_date_coverage(spark, sf_dir):
    return P.date_coverage(feed(spark, sf_dir), COVER_START, COVER_END)


@register(
    "coverage_ready",
    FEED
    + f"""SELECT count(*) = 0 AS ready, count(*) AS n_missing
FROM generate_series(DATE '2023-12-30', DATE '2024-02-02', INTERVAL 1 DAY) AS g(d)
WHERE strftime(d, '%Y%m%d') NOT IN (SELECT DISTINCT dt FROM feed WHERE dt IS NOT NULL)""",
)
def q_coverage_ready(spark, sf_dir):
    return P.coverage_ready(P.date_coverage(feed(spark, sf_dir), COVER_START, COVER_END))


_DAYS = ["20240115", "20240131", "20231231", "20240101"]
_PRESENT_SQL = (
    FEED
    + "SELECT w.dt, w.dt IN (SELECT DISTINCT dt FROM feed WHERE dt IS NOT NULL) AS present FROM (VALUES "
    + ", ".join(f"('{d}')" for d in _DAYS)
    + ") AS w(dt)"
)


@register("partition_present", _PRESENT_SQL)
def q_partition_present(spark, sf_dir):
    return P.partition_present(feed(spark, sf_dir), _DAYS)


def _stored_by_day(spark, sf_dir) -> str:
    """The feed written into ``dt=<day>`` directories."""
    root = scratch_path(spark, "feed_by_day")
    feed(spark, sf_dir).repartition("dt").write.partitionBy("dt").parquet(root)
    return root


@register("date_range_scan_stored", FEED + "SELECT * FROM feed WHERE dt BETWEEN '20240105' AND '20240110'")
def q_date_range_scan_stored(spark, sf_dir):
    return P.date_range_scan(_stored_by_day(spark, sf_dir), "20240105", "20240110", spark=spark)


@register("date_coverage_stored", _COVER_SQL)
def q_date_coverage_stored(spark, sf_dir):
    return P.date_coverage(_stored_by_day(spark, sf_dir), COVER_START, COVER_END, spark=spark)


@register("date_range_scan", FEED + "SELECT * FROM feed WHERE dt BETWEEN '20240105' AND '20240110'")
def q_date_range_scan(spark, sf_dir):
    return P.date_range_scan(feed(spark, sf_dir), "20240105", "20240110")


# Days of several layouts and schemas under one root: until the turn the day directories are plain, have no event name and hold the code as an
# int; from it on they are ``dt=`` partitions with the name and the code as a long. The day of the turn is stored in both, half each.
MIXED_START, MIXED_TURN, MIXED_END = "20240104", "20240108", "20240111"


def _mixed_days(spark, sf_dir) -> str:
    root = scratch_path(spark, "feed_mixed")
    rows = feed(spark, sf_dir).select("event_id", "event_name", F.col("error_code").cast("long").alias("error_code"), "value", "dt")
    early = F.col("event_id") % 2 == 0  # half of the day of the turn is in the old layout
    new = rows.where((F.col("dt") > MIXED_TURN) | ((F.col("dt") == MIXED_TURN) & ~early))
    new.where(F.col("dt") <= MIXED_END).repartition("dt").write.partitionBy("dt").parquet(root)
    old = rows.where((F.col("dt") < MIXED_TURN) | early).select("event_id", F.col("error_code").cast("int").alias("error_code"), "value", "dt")
    for (day,) in spark.range(1).select(F.explode(day_sequence(F.lit(MIXED_START), F.lit(MIXED_TURN)))).collect():
        old.where(F.col("dt") == day).drop("dt").write.parquet(f"{root}/{day}")
    return root


@register(
    "date_range_scan_mixed",
    FEED
    + f"""SELECT event_id, CAST(error_code AS BIGINT) AS error_code, value, dt,
       CASE WHEN dt > '{MIXED_TURN}' OR (dt = '{MIXED_TURN}' AND event_id % 2 <> 0) THEN event_name END AS event_name
FROM feed WHERE dt BETWEEN '20240106' AND '20240110'""",
)
def q_date_range_scan_mixed(spark, sf_dir):
    return P.date_range_scan(_mixed_days(spark, sf_dir), "20240106", "20240110", spark=spark)


@register(
    "date_coverage_mixed",
    FEED
    + f"""SELECT strftime(d, '%Y%m%d') AS dt
FROM generate_series(DATE '2024-01-01', DATE '2024-01-20', INTERVAL 1 DAY) AS g(d)
WHERE strftime(d, '%Y%m%d') NOT IN (SELECT DISTINCT dt FROM feed WHERE dt BETWEEN '{MIXED_START}' AND '{MIXED_END}')""",
)
def q_date_coverage_mixed(spark, sf_dir):
    return P.date_coverage(_mixed_days(spark, sf_dir), "20240101", "20240120", spark=spark)


@register("partition_present_table", _PRESENT_SQL)
def q_partition_present_table(spark, sf_dir):
    """The days of a catalog table, from its partitions."""
    path = scratch_path(spark, "feed_table")
    name = "feed_days_" + path.split("/")[-2]
    feed(spark, sf_dir).repartition("dt").write.partitionBy("dt").option("path", path).saveAsTable(name)
    return P.partition_present(name, _DAYS, spark=spark)
