"""Parquet sinks: training sets and feature maps.

Writes are single jobs over deterministic plans: the split column comes from a row hash, so a
re-executed task (or a second output path computed from the same plan) sees exactly the same
rows, and no caching is needed for correctness. Row counts, label rates and lengths per output are gathered with
``DataFrame.observe`` during the write instead of extra count jobs, and can be checked against the written footers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from keelson.operators.sampling import balance_then_sample, split_train_test


#: What is observed of each split while it is written.
SPLIT_METRICS = ("rows", "positives", "negatives", "unlabelled", "min_len", "max_len")


def _metrics(df: DataFrame, label: str, length_column: str | None, only=None, suffix: str = "") -> list:
    """Aggregates of the rows where ``only`` holds (all without it); a label that is neither 0 nor 1 counts as unlabelled."""
    chosen = F.lit(True) if only is None else only
    rows = [("rows", F.count(F.when(chosen, 1)))]
    if label in df.columns:
        c = F.col(label)
        known = F.coalesce(c.isin(0, 1), F.lit(False))
        rows += [
            ("positives", F.count(F.when(chosen & (c == 1), 1))),
            ("negatives", F.count(F.when(chosen & (c == 0), 1))),
            ("unlabelled", F.count(F.when(chosen & ~known, 1))),
        ]
    if length_column:
        size = F.when(chosen, F.size(length_column))
        rows += [("min_len", F.min(size)), ("max_len", F.max(size))]
    return [m.alias(name + suffix) for name, m in rows]


def _reported(split: str, found: dict) -> dict:
    row = {"split": split} | {m: found.get(m) for m in SPLIT_METRICS}
    known = (row["positives"] or 0) + (row["negatives"] or 0)
    return row | {"label_rate": row["positives"] / known if known else None}


def footer_statistics(spark: SparkSession, path: str, columns=()) -> dict:
    """Rows, and least and greatest values of ``columns``, as the Parquet footers under ``path`` state them.

    Read in a session of its own, in which aggregates are pushed into the Parquet source: no data page is read.
    """
    own = spark.newSession()
    listed = own.conf.get("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(x for x in listed.split(",") if x.strip() != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    extremes = [f(c).alias(f"{name}_{c}") for c in columns for f, name in ((F.min, "min"), (F.max, "max"))]
    return own.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), *extremes).first().asDict()


def write_train_test(
    df: DataFrame,
    base: str,
    weights=(0.8, 0.2),
    layout: str = "partitioned",
    partitions: int = -1,
    key=None,
    length_column: str | None = None,
    verify: bool = False,
    **balance_kw,
) -> dict:
    """Balance, sample and split ``df``, then write it.

    ``layout='partitioned'`` writes once to ``<base>`` partitioned by ``split``;
    ``layout='two_paths'`` writes ``<base>_train.parquet`` and ``<base>_test.parquet`` (two
    jobs over the same deterministic plan). ``partitions > 0`` repartitions before writing.
    Returns the paths, the observed metrics, and ``report``: per split its rows, its labels (1, 0, neither), the rate of 1 among
    the two, and, with ``length_column``, the least and greatest ``size()`` of that array column. ``verify`` compares the observed rows
    with the written footers and raises where they differ.
    """
    balance_kw.setdefault("rate", (1, 1))
    label = balance_kw.get("label", "label")
    split = split_train_test(df, weights, key=key, **balance_kw)
    if partitions > 0:
        split = split.repartition(partitions)  # not coalesce, which would pull the scan into so few tasks
    names = ("train", "test")
    if layout == "partitioned":
        obs = Observation("write_train_test")
        wanted = _metrics(split, label, length_column)
        for name in names:
            wanted += _metrics(split, label, length_column, F.col("split") == name, f"_{name}")
        split.observe(obs, *wanted).write.mode("overwrite").partitionBy("split").parquet(base)
        paths = {name: f"{base}/split={name}" for name in names}
        metrics = dict(obs.get)
        found = {name: {m: metrics.get(f"{m}_{name}") for m in SPLIT_METRICS} for name in names}
    elif layout == "two_paths":
        paths, metrics = {}, {}
        for name in names:
            paths[name] = f"{base}_{name}.parquet"
            part, obs = split.where(F.col("split") == name).drop("split"), Observation(f"write_{name}")
            part.observe(obs, *_metrics(part, label, length_column)).write.mode("overwrite").parquet(paths[name])
            metrics[name] = dict(obs.get)
        found = metrics
    else:
        raise ValueError(f"unknown layout {layout!r}")
    if verify:
        for name in names:
            # A split without rows has no directory of its own in the partitioned layout.
            stored = footer_statistics(df.sparkSession, paths[name])["rows"] if found[name]["rows"] else 0
            if stored != found[name]["rows"]:
                raise IOError(f"{paths[name]} holds {stored} rows, {found[name]['rows']} were written")
    return {"paths": paths, "metrics": metrics, "report": [_reported(name, found[name]) for name in names]}


def write_all(df: DataFrame, base: str, key=None, **balance_kw) -> str:
    """Balance and sample ``df`` and write it whole to ``<base>_all.parquet``; returns the path."""
    balance_kw.setdefault("rate", (1, 1))
    path = f"{base}_all.parquet"
    balance_then_sample(df, key=key, **balance_kw).write.mode("overwrite").parquet(path)
    return path


def write_feature_map(feature_map: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """Persist a feature map table. By default an existing target fails the write."""
    feature_map.write.mode(mode).parquet(path)
    return path


def read_feature_map(spark: SparkSession, path: str) -> DataFrame:
    """Load a persisted feature map."""
    return spark.read.parquet(path)
