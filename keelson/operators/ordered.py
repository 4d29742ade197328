"""Running totals in a global order without a single-task window, and rank lookups on them.

A window ordered over a whole group (``Window.partitionBy(feature).orderBy(value)``) puts every
distinct value of the group into one task. ``running_totals`` instead range-partitions the rows
on ``(group, order)`` so each task holds one slice of the order, computes running sums inside
the slice, and adds the totals of the slices before it (a table of one row per group and slice,
so its size is bounded by groups x partitions and it can be broadcast). The sliced table is
written once to the shared checkpoint folder so the offsets and the rows they apply to come
from the same evaluation of the range partitioning.

``running_totals`` gives every row its running sum (AUC needs all of them). When only a few
ranks are wanted (percentiles), ``sliced_counts`` + ``select_at_ranks`` place each rank in its
slice from the slice table and order only the touched slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.session import materialize


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))


def running_totals(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    weights: Sequence[str],
    partitions: int | None = None,
) -> DataFrame:
    """Adds ``cum_<w>`` (inclusive running sum in ascending ``order`` within ``by``) and
    ``tot_<w>`` (group total) for each weight column, and keeps the slice id ``_slice``
    (rank lookups use it to touch only one slice per target). ``order`` must be unique within a
    group (run it on a ``groupBy(by + [order])`` result)."""
    by = list(by)
    n = _partitions(df, partitions)
    ranged = df.repartitionByRange(n, *[F.col(c) for c in by], F.col(order)).withColumn(
        "_slice", F.spark_partition_id()
    )
    local_w = (
        Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = ranged.select("*", *[F.sum(w).over(local_w).alias(f"_loc_{w}") for w in weights])
    # Slice ids depend on the sampled range bounds, so every later use must read one
    # evaluation: write it once to the shared checkpoint folder.
    local = materialize(local, "running_totals")
    slices = local.groupBy(*by, "_slice").agg(*[F.sum(w).alias(f"_sl_{w}") for w in weights])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    offsets = slices.select(
        *by,
        "_slice",
        *[F.coalesce(F.sum(f"_sl_{w}").over(before), F.lit(0)).alias(f"_off_{w}") for w in weights],
        *[F.sum(f"_sl_{w}").over(whole).alias(f"tot_{w}") for w in weights],
    )
    # Groups x slices rows: bounded by the caller's group count times the partition count.
    joined = local.join(F.broadcast(offsets), [*by, "_slice"])
    return joined.select(
        *[c for c in df.columns],
        "_slice",
        *[(F.col(f"_loc_{w}") + F.col(f"_off_{w}")).alias(f"cum_{w}") for w in weights],
        *[F.col(f"tot_{w}") for w in weights],
    )


def top_k_per_group(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence,
    k: int,
    rank: str = "_rank",
    salts: int | None = None,
) -> DataFrame:
    """The first ``k`` rows of each group in ``order`` (which must be total within a group),
    with their 1-based ``rank``.

    Exact and bounded per task whatever the group size: rows are first ranked inside
    (group, salt) buckets, salt = a hash of the row, keeping ``k`` per bucket; the global top
    ``k`` of a group is among those survivors, so the second ranking sees at most
    ``k * salts`` rows per group. (Spark's window group limit gives the same effect only when
    the optimizer recognises the pattern; this does not depend on it.)
    """
    by = list(by)
    n = _partitions(df, salts)
    cols = [F.col(c) for c in df.columns]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*cols), F.lit(n)))
    first = Window.partitionBy(*by, "_salt").orderBy(*order)
    kept = salted.withColumn("_r1", F.row_number().over(first)).where(F.col("_r1") <= k).drop("_salt", "_r1")
    second = Window.partitionBy(*by).orderBy(*order)
    return kept.withColumn(rank, F.row_number().over(second)).where(F.col(rank) <= k)


def sliced_counts(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    weight: str,
    partitions: int | None = None,
    extra: Sequence = (),
) -> tuple[DataFrame, DataFrame]:
    """Range-slice ``df`` (distinct ``order`` values per group with a ``weight`` count) and
    write it once to the shared checkpoint folder.

    Returns ``(table, slices)``: the written rows with their ``_slice``, and one row per group
    and slice with the slice's weight ``_sw``, the weight of earlier slices ``_off``, and the
    group total ``_tot`` (groups x slices rows, a size fixed by the caller and the partition
    count). No running sum over all rows is built: ``select_at_ranks`` orders only the slices
    that hold a wanted rank. ``extra`` are more aggregate columns computed per group and slice in
    the same pass (summed per group by the caller).
    """
    by = list(by)
    n = _partitions(df, partitions)
    ranged = df.repartitionByRange(n, *[F.col(c) for c in by], F.col(order)).withColumn(
        "_slice", F.spark_partition_id()
    )
    table = materialize(ranged, "sliced_counts")
    per = table.groupBy(*by, "_slice").agg(F.sum(weight).alias("_sw"), *extra)
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    slices = per.select(
        *by,
        "_slice",
        "_sw",
        F.coalesce(F.sum("_sw").over(before), F.lit(0)).alias("_off"),
        F.sum("_sw").over(whole).alias("_tot"),
        *[c for c in per.columns if c not in (*by, "_slice", "_sw")],
    )
    return table, slices


def select_at_ranks(
    table: DataFrame,
    slices: DataFrame,
    targets: DataFrame,
    by: Sequence[str],
    keys: Sequence[str],
    order: str,
    weight: str,
    rank_cols: Sequence[str],
) -> DataFrame:
    """For each target row (``by`` + ``keys`` + 0-based ``rank_cols``), the ``order`` value at
    each rank, from the output of ``sliced_counts``.

    Each rank is placed in its slice using the small slice table; only the rows of touched
    slices are read and ordered (a window per touched slice, each slice being one range
    partition's share of the group), and matched to the ranks placed there.
    """
    by, keys = list(by), list(keys)
    stacked = targets.select(
        *by,
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(r).alias("_which"), F.col(r).cast("long").alias("_rank")) for r in rank_cols])
        ).alias("_t"),
    ).select(*by, *keys, "_t._which", "_t._rank")
    rank = F.col("_rank")
    placed = (
        stacked.join(F.broadcast(slices), by)
        .where((rank >= F.col("_off")) & (rank < F.col("_off") + F.col("_sw")))
        .select(*by, *keys, "_which", "_rank", "_slice", "_off")
    )
    # targets x rank columns rows: a size fixed by the caller. A semi join keeps the rows of
    # touched slices without de-duplicating the slice list first.
    sub = table.join(F.broadcast(placed.select(*by, "_slice")), [*by, "_slice"], "left_semi")
    w = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = sub.select(*by, "_slice", order, weight, F.sum(weight).over(w).alias("_loc"))
    hi = F.col("_off") + F.col("_loc")
    lo = hi - F.col(weight)
    hits = local.join(F.broadcast(placed), [*by, "_slice"]).where((lo <= rank) & (rank < hi))
    agg = hits.groupBy(*by, *keys).agg(
        *[F.max(F.when(F.col("_which") == r, F.col(order))).alias(f"{r}_value") for r in rank_cols]
    )
    return targets.join(agg, [*by, *keys], "left")
