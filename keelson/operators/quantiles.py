"""Exact and approximate percentiles of many numeric columns in one plan, and dense feature maps.

Columns are exploded into a long ``(fid, value)`` layout (integer feature index, value cast to
double; nulls and NaN dropped), reduced to distinct values with counts (map-side partial
aggregation), range-sliced and written once (``sliced_counts``), and looked up at the ranks each
percentile needs: a rank is placed in its slice from the small slice table, and only the touched
slices are ordered (``select_at_ranks``), so the distinct values are shuffled twice (aggregate,
range slice) and never sorted as a whole. Positive-only percentiles reuse the same ranking,
shifted past the values <= 0. One pass covers every feature.

Midpoint rule (as NumPy ``method='midpoint'``): with ``q = p / 100`` and ``n`` values, the
virtual index is ``v = (n - 1) * q`` in double precision; an integral ``v`` gives the value at
rank ``v``, otherwise ``b - (b - a) * 0.5`` where ``a`` and ``b`` are the values at ranks
``floor(v)`` and ``floor(v) + 1`` (ranks 0-based, clipped to ``n - 1``).

Discrete rule (exact mode of the approximate map): the value at rank ``ceil(q*n) - 1``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.operators.filters import require_features
from keelson.operators.ordered import select_at_ranks, sliced_counts
from keelson.operators.sampling import sample_to_cap

DEFAULT_PERCENTILES = (0, 5, 25, 50, 75, 90, 95, 99, 100)
BY = ["fid"]
VARIANTS = ("all", "positive")


def numeric_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(fid, value)`` rows: feature index and value as double, nulls and NaN dropped."""
    cols = list(columns)
    pairs = F.array(*[F.struct(F.lit(i).alias("fid"), F.col(c).cast("double").alias("value")) for i, c in enumerate(cols)])
    long = df.select(F.explode(pairs).alias("_p")).select("_p.fid", "_p.value")
    return long.where(F.col("value").isNotNull() & ~F.isnan("value"))


class Ranked:
    """Distinct values per feature, range-sliced and written once, with the slice table and
    per-feature sizes (all values, and values <= 0 for the positive-only variant)."""

    def __init__(self, long: DataFrame, partitions: int | None = None):
        vc = long.groupBy("fid", "value").agg(F.count(F.lit(1)).alias("cnt"))
        nonpos = F.coalesce(F.sum(F.when(F.col("value") <= 0, F.col("cnt"))), F.lit(0)).alias("_np")
        self.table, self.slices = sliced_counts(vc, BY, "value", "cnt", partitions, extra=[nonpos])
        # Per feature from the (groups x slices) table: no second pass over the values.
        self.sizes = self.slices.groupBy("fid").agg(
            F.max("_tot").alias("n_all"), F.sum("_np").alias("n_nonpos")
        )

    def values_at(self, targets: DataFrame, keys: Sequence[str], rank_cols: Sequence[str]) -> DataFrame:
        return select_at_ranks(self.table, self.slices, targets, BY, keys, "value", "cnt", rank_cols)


def ranked_values(long: DataFrame, partitions: int | None = None) -> Ranked:
    """Rank structure over ``(fid, value)`` rows. Only one ranking per feature is built: the
    positive-only ranks are the same ranks shifted past the values <= 0."""
    return Ranked(long, partitions)


def _groups(ranked: Ranked, variants: Sequence[str]) -> DataFrame:
    """``(fid, variant, n, skip)``: values in the variant and ranks to skip to reach it.
    One row per feature and variant, bounded by the caller's column list."""
    g = ranked.sizes
    rows = []
    if "all" in variants:
        rows.append(F.struct(F.lit("all").alias("variant"), F.col("n_all").alias("n"), F.lit(0).cast("long").alias("skip")))
    if "positive" in variants:
        rows.append(
            F.struct(
                F.lit("positive").alias("variant"),
                (F.col("n_all") - F.col("n_nonpos")).alias("n"),
                F.col("n_nonpos").cast("long").alias("skip"),
            )
        )
    return g.select("fid", F.explode(F.array(*rows)).alias("_g")).select("fid", "_g.*").where(F.col("n") > 0)


def _percentile_table(percentiles: Sequence[float]) -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(float(p)).alias("percentile"), F.lit(float(p) / 100.0).alias("q")) for p in percentiles])
    )


def _named(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    names = F.array(*[F.lit(c) for c in columns])
    return df.withColumn("feature", F.element_at(names, F.col("fid") + 1)).drop("fid")


def midpoint_percentiles(
    cum: Ranked, columns: Sequence[str], percentiles: Sequence[float] = DEFAULT_PERCENTILES,
    variants: Sequence[str] = VARIANTS,
) -> DataFrame:
    """``(feature, variant, percentile, value)`` by the midpoint rule from ``ranked_values``."""
    g = _groups(cum, variants).select("fid", "variant", "n", "skip", _percentile_table(percentiles).alias("pq"))
    q = F.col("pq.q")
    v = (F.col("n") - 1).cast("double") * q
    fl = F.floor(v)
    targets = g.select(
        "fid",
        "variant",
        F.col("pq.percentile").alias("percentile"),
        (v == fl).alias("integral"),
        (F.greatest(F.least(fl, F.col("n") - 1), F.lit(0)) + F.col("skip")).cast("long").alias("lo_rank"),
        (F.greatest(F.least(fl + 1, F.col("n") - 1), F.lit(0)) + F.col("skip")).cast("long").alias("hi_rank"),
    )
    found = cum.values_at(targets, ["variant", "percentile"], ["lo_rank", "hi_rank"])
    a, b = F.col("lo_rank_value"), F.col("hi_rank_value")
    value = F.when(F.col("integral"), a).otherwise(b - (b - a) * F.lit(0.5))
    return _named(found.select("fid", "variant", "percentile", value.alias("value")), columns).select(
        "feature", "variant", "percentile", "value"
    )


def discrete_quantiles(cum: Ranked, columns: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    """``(feature, variant, quantile, value)`` over all values: the value at rank
    ``ceil(q*n) - 1``."""
    qs = F.explode(F.array(*[F.lit(float(x)) for x in quantiles]))
    g = _groups(cum, ["all"]).select("fid", "variant", "n", qs.alias("quantile"))
    rank = F.greatest(F.ceil(F.col("quantile") * F.col("n").cast("double")) - 1, F.lit(0)).cast("long")
    targets = g.select("fid", "variant", "quantile", rank.alias("rank"))
    found = cum.values_at(targets, ["variant", "quantile"], ["rank"])
    return _named(found.select("fid", "variant", "quantile", F.col("rank_value").alias("value")), columns).select(
        "feature", "variant", "quantile", "value"
    )


def percentiles_midpoint(
    df: DataFrame,
    columns: Sequence[str],
    percentiles: Sequence[float] = DEFAULT_PERCENTILES,
    partitions: int | None = None,
) -> DataFrame:
    """Midpoint percentiles (0 = min, 50 = median, 100 = max) of each column, over all
    values (``variant='all'``) and over positive values only (``variant='positive'``; absent
    for a column with no positive value)."""
    cols = list(columns)
    cum = ranked_values(numeric_long(df, cols), partitions)
    return midpoint_percentiles(cum, cols, percentiles)


def _maybe_cap(df: DataFrame, max_rows: int | None, key) -> DataFrame:
    return df if max_rows is None else sample_to_cap(df, max_rows, key=key)


DENSE_SCHEMA = "feature string, kind string, min double, max double"


def _no_dense(df: DataFrame) -> DataFrame:
    """The empty dense map (every requested feature was missing)."""
    return df.sparkSession.createDataFrame([], DENSE_SCHEMA)


def _dense_rows(bounds: DataFrame, lo: str, hi: str) -> DataFrame:
    return bounds.where(F.col(lo) < F.col(hi)).select(
        "feature",
        F.lit("dense").alias("kind"),
        F.lit(0.0).alias("min"),
        F.col(hi).alias("max"),
    )


def dense_map_exact(
    df: DataFrame,
    features: Sequence[str],
    max_rows: int | None = None,
    key=None,
    ignore_missing: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Keep a feature when its positive-only midpoint p5 < p99; its range is [0, p99].
    ``max_rows`` optionally hash-samples the input down to that many rows first."""
    feats = require_features(df, features, ignore_missing)
    if not feats:
        return _no_dense(df)
    src = _maybe_cap(df.select(*feats), max_rows, key)
    cum = ranked_values(numeric_long(src, feats), partitions)
    p = midpoint_percentiles(cum, feats, (5, 99), variants=("positive",))
    bounds = p.groupBy("feature").agg(
        F.max(F.when(F.col("percentile") == 5.0, F.col("value"))).alias("p5"),
        F.max(F.when(F.col("percentile") == 99.0, F.col("value"))).alias("p99"),
    )
    return _dense_rows(bounds, "p5", "p99")


def dense_map_approx(
    df: DataFrame,
    features: Sequence[str],
    rel_error: float = 0.01,
    quantiles: tuple[float, float] = (0.1, 0.95),
    max_rows: int | None = None,
    key=None,
    ignore_missing: bool = True,
    partitions: int | None = None,
) -> DataFrame:
    """Keep a feature when its q10 < q95 over all values (zeros included); range [0, q95].

    ``rel_error > 0`` uses ``percentile_approx`` sketches (accuracy ``1 / rel_error``), one
    partial sketch per task and feature merged at the end; ``rel_error == 0`` is exact
    (discrete rank ``ceil(q*n) - 1``)."""
    feats = require_features(df, features, ignore_missing)
    if not feats:
        return _no_dense(df)
    src = _maybe_cap(df.select(*feats), max_rows, key)
    lo_q, hi_q = quantiles
    long = numeric_long(src, feats)
    if rel_error > 0:
        acc = max(1, int(round(1.0 / rel_error)))
        bounds = long.groupBy("fid").agg(
            F.percentile_approx("value", F.array(F.lit(lo_q), F.lit(hi_q)), acc).alias("qs")
        )
        bounds = _named(bounds.select("fid", F.col("qs")[0].alias("lo"), F.col("qs")[1].alias("hi")), feats)
    else:
        qv = discrete_quantiles(ranked_values(long, partitions), feats, (lo_q, hi_q))
        bounds = qv.groupBy("feature").agg(
            F.max(F.when(F.col("quantile") == lo_q, F.col("value"))).alias("lo"),
            F.max(F.when(F.col("quantile") == hi_q, F.col("value"))).alias("hi"),
        )
    return _dense_rows(bounds, "lo", "hi")
