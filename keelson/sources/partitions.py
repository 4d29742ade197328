"""Day-partitioned sources: range scans, coverage checks and partition presence.

Two storage layouts are read, also mixed under one root and for one day: ``<root>/dt=yyyyMMdd/...`` and plain day directories
``<root>/yyyyMMdd[/<child>]``. Day directories come from one glob, which of them hold data from one Spark listing of the days asked
about (no data is read), and only those are scanned. Where all are in the first layout, the day stays a partition column, so
later filters prune.

Days may differ in their columns and types: the result has all columns, missing ones null, with the wider type of each.

Every function also accepts a DataFrame that has the day column, or the name of a catalog table, whose days come from ``SHOW PARTITIONS`` if it is
partitioned by the day column.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.functions.dates import day_sequence


def _day_folders(
    spark: SparkSession, root: str, column: str, child: str | None, start: str | None = None, end: str | None = None
) -> tuple[str, list[tuple[str, str]]]:
    """The root as its file system writes it, and ``(day, name)`` of every day directory under it that lies between the bounds
    (and has the child); one call whatever their number."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    inner = f"/{child.strip('/')}" if child else ""
    found = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/*{inner}"))
    base = fs.makeQualified(path).toString().rstrip("/")
    if not found:
        return base, []
    # All paths leave the JVM as one text: a job's input setting, in which commas are escaped.
    job = jvm.org.apache.hadoop.mapred.JobConf(False)
    jvm.org.apache.hadoop.mapred.FileInputFormat.setInputPaths(job, jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found))
    listed = re.split(r"(?<!\\),", job.get("mapreduce.input.fileinputformat.inputdir"))
    names = [re.sub(r"\\(.)", r"\1", p).removeprefix(base + "/").removesuffix(inner) for p in listed]
    days = [(n.removeprefix(f"{column}="), n) for n in names]
    days = [(d, n) for d, n in days if n != d or (len(d) == 8 and d.isdigit())]
    return base, sorted((d, n) for d, n in days if (start is None or d >= start) and (end is None or d <= end))


def _holding_data(spark: SparkSession, base: str, names: Sequence[str], child: str | None) -> set[str]:
    """Those of the day directories that hold a data file, from one listing that Spark shares out."""
    if not names:
        return set()
    inner = f"/{child.strip('/')}" if child else ""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load([f"{base}/{n}{inner}" for n in names])
    name = F.substring_index(F.substr("path", F.lit(len(base) + 2)), "/", 1)
    return {r[0] for r in files.select(name).distinct().collect()}  # a row per day directory


def _alike(spark: SparkSession, paths: list[str], fmt: str, options: dict[str, str]) -> list[DataFrame]:
    """Reads of runs of ``paths`` whose files' schemas Spark can merge: halves where it cannot."""
    try:
        return [spark.read.format(fmt).options(mergeSchema=True, **options).load(paths)]
    except Exception as e:  # the JVM's own error class
        if "CANNOT_MERGE" not in str(e) or len(paths) == 1:
            raise
        half = len(paths) // 2
        return _alike(spark, paths[:half], fmt, options) + _alike(spark, paths[half:], fmt, options)


def _united(a: DataFrame, b: DataFrame) -> DataFrame:
    """All columns and rows; where one side is text, text, else Spark's wider type."""
    for name in set(a.columns) & set(b.columns):
        kinds = [x.schema[name].dataType for x in (a, b)]
        if kinds[0] != kinds[1] and any(isinstance(k, T.StringType) for k in kinds):
            a, b = (x.withColumn(name, F.col(name).cast("string")) for x in (a, b))
    return a.unionByName(b, allowMissingColumns=True)


def _read_days(spark: SparkSession, root: str, start: str, end: str, column: str, child: str | None, fmt: str) -> DataFrame:
    """The days of the range from either layout, with their day as a string in ``column``."""
    base, folders = _day_folders(spark, root, column, child)
    inner = f"/{child.strip('/')}" if child else ""
    asked = [n for d, n in folders if start <= d <= end]
    holding = _holding_data(spark, base, asked, child)
    names = [n for n in asked if n in holding]
    if not names:  # any day gives the schema
        holding = _holding_data(spark, base, [n for _, n in folders], child)
        names = [n for _, n in folders if n in holding][:1]
        if not names:
            raise FileNotFoundError(f"no day directory with data under {root}")
    paths = [f"{base}/{n}{inner}" for n in names]
    if child is None and all(n.startswith(f"{column}=") for n in names):
        # The partition column is read as Spark infers it and compared as text, which keeps the pruning.
        reads = [df.withColumn(column, F.col(column).cast("string")) for df in _alike(spark, paths, fmt, {"basePath": base})]
    else:
        # The day is taken from the file's path, right after the root. A stored column of that name gives way.
        day = F.regexp_extract(F.col("_metadata.file_path"), rf"/(?:{column}=)?([0-9]{{8}}){inner}/[^/]*$", 1)
        reads = [df.withColumn(column, day) for df in _alike(spark, paths, fmt, {})]
    return functools.reduce(_united, reads).where(F.col(column).between(start, end))


def _table(spark: SparkSession, source: str) -> bool:
    return "/" not in source and spark.catalog.tableExists(source)


def date_list(spark: SparkSession, start: str, end: str) -> DataFrame:
    """All days of an inclusive range as rows ``(dt)``; empty when ``start > end``."""
    return spark.range(1).select(F.explode(day_sequence(F.lit(start), F.lit(end))).alias("dt"))


def date_range_scan(
    source: str | DataFrame,
    start: str,
    end: str,
    column: str = "dt",
    spark: SparkSession | None = None,
    child: str | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Rows of the days ``start..end`` inclusive (empty when reversed). On a path only the day directories of the
    range are read; ``child`` names a directory inside each day."""
    spark = spark or SparkSession.getActiveSession()
    if isinstance(source, str) and not _table(spark, source):
        return _read_days(spark, source, start, end, column, child, fmt)
    c = F.col(column)
    rows = source if isinstance(source, DataFrame) else spark.table(source)
    return rows.where((c >= F.lit(start)) & (c <= F.lit(end)))


def listed_days(
    spark: SparkSession, root: str, column: str = "dt", child: str | None = None,
    start: str | None = None, end: str | None = None,
) -> list[str]:
    """Days under ``root`` (either layout) whose directory, or its ``child``, holds data; no data is read. Only
    days between ``start`` and ``end`` are looked into."""
    base, folders = _day_folders(spark, root, column, child, start, end)
    holding = _holding_data(spark, base, [n for _, n in folders], child)
    return sorted({d for d, n in folders if n in holding})


def present_days(
    source: str | DataFrame, column: str = "dt", spark: SparkSession | None = None, child: str | None = None,
    start: str | None = None, end: str | None = None,
) -> DataFrame:
    """Distinct days present in the source (between the bounds): for a path, from the directory listing, for a
    table partitioned by day, from its partitions (metadata only both); for other tables and DataFrames, a distinct over the day column."""
    c = F.col(column)
    if isinstance(source, str):
        spark = spark or SparkSession.getActiveSession()
        if not _table(spark, source):
            days = listed_days(spark, source, column, child, start, end)
            return spark.createDataFrame([(d,) for d in days], "dt string")
        if any(x.isPartition and x.name == column for x in spark.catalog.listColumns(source)):
            source = spark.sql(f"SHOW PARTITIONS {source}")
            c = F.regexp_extract("partition", rf"(?:^|/){column}=([^/]*)", 1)
        else:
            source = spark.table(source)
    inside = [c >= F.lit(start)] * (start is not None) + [c <= F.lit(end)] * (end is not None)
    rows = source
    for condition in inside:
        rows = rows.where(condition)
    return rows.select(c.alias("dt")).distinct()


def date_coverage(
    source: str | DataFrame, start: str, end: str, column: str = "dt", spark: SparkSession | None = None,
    child: str | None = None,
) -> DataFrame:
    """Expected days of ``start..end`` that are absent from the source: rows ``(dt)``. On a path, a day
    counts if its directory (or the ``child`` in it) holds data.

    The range is ready when this is empty; ``coverage_ready`` gives the one-row verdict.
    """
    spark = source.sparkSession if isinstance(source, DataFrame) else (spark or SparkSession.getActiveSession())
    expected = spark.range(1).select(F.explode(day_sequence(F.lit(start), F.lit(end))).alias("dt"))
    return expected.join(present_days(source, column, spark, child, start, end), "dt", "left_anti")


def coverage_ready(missing: DataFrame) -> DataFrame:
    """One row ``(ready, n_missing)`` from the output of ``date_coverage``."""
    return missing.agg(F.count(F.lit(1)).alias("n_missing")).select(
        (F.col("n_missing") == 0).alias("ready"), "n_missing"
    )


def partition_present(
    source: str | DataFrame, days: Sequence[str], column: str = "dt", spark: SparkSession | None = None,
    child: str | None = None,
) -> DataFrame:
    """For each requested day: is it present in the source? Rows ``(dt, present)``."""
    spark = source.sparkSession if isinstance(source, DataFrame) else (spark or SparkSession.getActiveSession())
    wanted = spark.createDataFrame([(d,) for d in dict.fromkeys(days)], "dt string")
    bounds = (min(days), max(days)) if days else (None, None)
    present = present_days(source, column, spark, child, *bounds).withColumn("present", F.lit(True))
    return wanted.join(present, "dt", "left").select("dt", F.coalesce("present", F.lit(False)).alias("present"))
