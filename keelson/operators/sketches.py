"""Distinct entities over any range of days from stored sketches.

Exact distinct counts do not add up over days, so every new range scans its days again. Here each day (and group) is read once: its entities go into a
HyperLogLog sketch of fixed size, kept as a binary column beside the number of rows. A range is the union of its days' sketches, a job over
days x groups small rows. The estimate's relative standard error is ``1.04 / sqrt(2 ** lg_k)`` (1.6 % for 12) whatever the number of days; nulls, one entity as
in the exact counts, are counted apart and exactly.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.numeric import share

LG_K = 12


def error_bound(lg_k: int = LG_K, deviations: float = 4.0) -> float:
    """Relative error of an estimate, at so many standard deviations."""
    return deviations * 1.04 / 2 ** (lg_k / 2)


def daily_sketches(df: DataFrame, entity: str, day: str = "dt", by: Sequence[str] = (), lg_k: int = LG_K) -> DataFrame:
    """One row per day and group: ``(day, by..., n_rows, n_null, sketch)``; ``n_null`` are the rows without an entity. Partial sketches are merged
    map-side, so a hot day or group is one row per task before the shuffle."""
    c = F.col(entity)
    return df.groupBy(day, *by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(c.isNull(), 1)).alias("n_null"),
        F.hll_sketch_agg(c.cast("string"), lg_k).alias("sketch"),
    )


def entities_over(
    sketches: DataFrame, start: str | None = None, end: str | None = None, by: Sequence[str] = (), day: str = "dt"
) -> DataFrame:
    """``(by..., n_rows, n_entities)`` over the stored days ``start..end``; any of the stored groups can be left out of ``by``, their
    entities are then united."""
    inside = sketches
    if start is not None:
        inside = inside.where(F.col(day) >= F.lit(start))
    if end is not None:
        inside = inside.where(F.col(day) <= F.lit(end))
    # Without rows there is no sketch, and no entity.
    known = F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch")), F.lit(0))
    null = (F.coalesce(F.sum("n_null"), F.lit(0)) > 0).cast("long")
    rows = F.coalesce(F.sum("n_rows"), F.lit(0)).cast("long")
    return inside.groupBy(*by).agg(rows.alias("n_rows"), (known + null).cast("long").alias("n_entities"))


def penetration_over(
    sketches: DataFrame, by: Sequence[str], start: str | None = None, end: str | None = None, day: str = "dt", digits: int = 5
) -> DataFrame:
    """``(by..., n_rows, n_entities, share)``: each group's entities among those of all groups, over a range of stored days."""
    every = entities_over(sketches, start, end, (), day).select("n_entities")
    each = entities_over(sketches, start, end, by, day).withColumn("_all", every.scalar())
    return each.withColumn("share", share("n_entities", "_all", digits)).drop("_all")
