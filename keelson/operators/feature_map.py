"""Sparse vocabularies, the combined feature map, its summary and a quick feature profile.

Feature map layout (one table for both kinds):
``feature, kind ('dense'|'sparse'), position, value, cnt, rate, min, max`` - sparse features have
one row per vocabulary entry (``position`` 1-based, by count desc then value asc, nulls last;
null is a value); dense features one row with their range. A typed map has one more column, ``value_type``
(:func:`keelson.operators.counts.value_type`), by which values of one text and different types are apart.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.numeric import share
from keelson.operators.counts import multi_value_counts
from keelson.operators.filters import require_features
from keelson.operators.ordered import top_k_per_group
from keelson.operators.quantiles import dense_map_approx, dense_map_exact, percentiles_midpoint
from keelson.operators.sampling import sample_to_cap

MAP_COLUMNS = ["feature", "kind", "position", "value", "cnt", "rate", "min", "max"]


def _by_freq(partition: str = "feature", more: Sequence[str] = ()) -> Window:
    return Window.partitionBy(partition).orderBy(F.col("cnt").desc(), F.col("value").asc_nulls_last(), *more)


def sparse_map(
    df: DataFrame,
    features: Sequence[str],
    min_share: float = 0.001,
    max_len: int = 100,
    max_rows: int | None = None,
    key=None,
    batch_size: int | None = None,
    ignore_missing: bool = True,
    typed: bool = False,
) -> DataFrame:
    """Per feature, the values whose share of rows is at least ``min_share``, by count
    desc; the feature is kept when it has between 2 and ``max_len`` such values.

    The share filter runs before any per-feature window, so a window never holds more than
    ``1 / min_share`` values whatever the cardinality of the column.
    """
    feats = require_features(df, features, ignore_missing)
    kind = ["value_type"] * typed
    if not feats:
        return df.sparkSession.createDataFrame(
            [], "feature string, kind string, position bigint, value string, cnt bigint, rate double" + ", value_type string" * typed
        )
    counts = multi_value_counts(sample_to_cap(df, max_rows, key=key).select(*feats), feats, batch_size, typed)
    # Every feature's counts sum to the row count: one row per feature, broadcast.
    totals = counts.groupBy("feature").agg(F.sum("cnt").alias("_n"))
    rate = F.col("cnt").cast("double") / F.col("_n").cast("double")
    kept = counts.join(F.broadcast(totals), "feature").where(rate >= F.lit(float(min_share)))
    w_all = Window.partitionBy("feature")
    kept = kept.select(
        "feature", "value", "cnt", rate.alias("rate"), *kind,
        F.count(F.lit(1)).over(w_all).alias("_len"),
        F.row_number().over(_by_freq(more=kind)).cast("long").alias("position"),
    )
    return kept.where((F.col("_len") >= 2) & (F.col("_len") <= max_len)).select(
        "feature", F.lit("sparse").alias("kind"), "position", "value", "cnt", "rate", *kind
    )


def feature_map(
    df: DataFrame,
    dense: Sequence[str] = (),
    sparse: Sequence[str] = (),
    dense_method: str = "approx",
    given: DataFrame | None = None,
    rel_error: float = 0.01,
    min_share: float = 0.001,
    max_len: int = 100,
    max_rows: int | None = None,
    key=None,
    batch_size: int | None = None,
    typed: bool = False,
) -> DataFrame:
    """Generate the map for the dense and sparse features (or pass ``given`` through),
    as one table with the common layout (``typed``: with ``value_type``). ``max_rows`` samples the input of both parts first (off by default)."""
    if given is not None:
        return given
    parts = []
    df = sample_to_cap(df, max_rows, key=key)
    if dense:
        if dense_method == "exact":
            parts.append(dense_map_exact(df, dense))
        else:
            parts.append(dense_map_approx(df, dense, rel_error=rel_error))
    if sparse:
        parts.append(sparse_map(df, sparse, min_share, max_len, batch_size=batch_size, typed=typed))
    if not parts:
        raise ValueError("no features requested")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    for c, t in [("position", "bigint"), ("value", "string"), ("cnt", "bigint"), ("rate", "double"),
                 ("min", "double"), ("max", "double"), ("value_type", "string")]:
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out.select(*MAP_COLUMNS, *["value_type"] * typed)


def feature_map_summary(fmap: DataFrame) -> DataFrame:
    """Per feature its width (1 for dense, vocabulary length for sparse) and range, then
    totals per kind and overall (``level`` = feature / kind / total). The overall width is the
    model input width."""
    per = fmap.groupBy("kind", "feature").agg(
        F.when(F.first("kind") == "dense", F.lit(1)).otherwise(F.count(F.lit(1))).cast("long").alias("width"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
    )
    roll = per.rollup("kind", "feature").agg(
        F.sum("width").alias("width"),
        F.count(F.lit(1)).alias("n_features"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.grouping_id().alias("_g"),
    )
    level = F.when(F.col("_g") == 0, "feature").when(F.col("_g") == 1, "kind").otherwise("total")
    return roll.select(level.alias("level"), "kind", "feature", "width", "n_features", "min", "max")


def feature_map_keys_check(fmap: DataFrame, requested: Sequence[str]) -> DataFrame:
    """For each requested feature name: whether the map has it, its kind and entry count."""
    spark = fmap.sparkSession
    wanted = spark.createDataFrame([(f,) for f in dict.fromkeys(requested)], "feature string")
    have = fmap.groupBy("feature").agg(F.first("kind").alias("kind"), F.count(F.lit(1)).alias("entries"))
    return wanted.join(have, "feature", "left").select(
        "feature", F.col("kind").isNotNull().alias("present"), "kind", "entries"
    )


def feature_profile(
    df: DataFrame, sparse: Sequence[str] = (), dense: Sequence[str] = (), top_n: int = 10, digits: int = 5
) -> DataFrame:
    """Top-``top_n`` value shares of the sparse columns and midpoint percentiles of the
    dense columns, as one long table (``kind`` sparse / dense)."""
    parts = []
    if sparse:
        counts = multi_value_counts(df, sparse)
        totals = counts.groupBy("feature").agg(F.sum("cnt").alias("_n"))
        # Exact top-n per feature, bounded per task however many distinct values a column has.
        order = [F.col("cnt").desc(), F.col("value").asc_nulls_last()]
        top = top_k_per_group(counts, ["feature"], order, top_n, rank="_rn")
        top = top.withColumn("position", F.col("_rn").cast("long"))
        parts.append(
            top.join(F.broadcast(totals), "feature").select(
                F.lit("sparse").alias("kind"), "feature", "position", "value", "cnt",
                share("cnt", "_n", digits).alias("share"),
            )
        )
    if dense:
        p = percentiles_midpoint(df, dense)
        parts.append(
            p.select(F.lit("dense").alias("kind"), "feature", "variant", "percentile", F.col("value").alias("stat"))
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
