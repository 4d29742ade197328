"""Outcome-code analysis (prediction logs with an integer outcome code).

Code 0 is a valid prediction, a positive code an error; null and negative codes count in the
totals only. Entities are counted as groups, so a null entity is one entity.

Both reports shuffle the input once, on the entity (with map-side partial aggregation, so a
hot entity such as null collapses to one row per map task before the exchange); everything
after that runs on per-entity aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.numeric import share


def _population_count(population: int | DataFrame | None) -> Column | DataFrame | None:
    if population is None or isinstance(population, int):
        return population
    return population.agg(F.count(F.lit(1)).alias("population"))


def outcome_funnel(
    df: DataFrame,
    entity: str = "did",
    code: str = "error_code",
    population: int | DataFrame | None = None,
    digits: int = 5,
) -> DataFrame:
    """One row: totals, valid / error rows and entities with shares, and entities that had an
    error and never a valid row. ``population`` is an external entity count (or a frame whose
    row count is used) for the ``valid_population_share`` column."""
    c = F.col(code)
    per_entity = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("r"),
        F.sum((c == 0).cast("long")).alias("v"),
        F.sum((c > 0).cast("long")).alias("e"),
    )
    one = F.lit(1)
    totals = per_entity.agg(
        F.sum("r").alias("total_rows"),
        F.count(one).alias("total_entities"),
        F.sum("v").alias("valid_rows"),
        F.count(F.when(F.col("v") > 0, one)).alias("valid_entities"),
        F.sum("e").alias("error_rows"),
        F.count(F.when(F.col("e") > 0, one)).alias("error_entities"),
        F.count(F.when((F.col("e") > 0) & (F.col("v") == 0), one)).alias("error_only_entities"),
    )
    pop = _population_count(population)
    # An external population frame enters as a scalar subquery (one value, no join).
    pop_col = pop.scalar() if isinstance(pop, DataFrame) else F.lit(pop).cast("long")
    return totals.select(
        "total_rows",
        "total_entities",
        "valid_rows",
        share("valid_rows", "total_rows", digits).alias("valid_row_share"),
        "valid_entities",
        share("valid_entities", "total_entities", digits).alias("valid_entity_share"),
        share(F.col("valid_entities"), pop_col, digits).alias("valid_population_share"),
        "error_rows",
        share("error_rows", "total_rows", digits).alias("error_row_share"),
        "error_entities",
        share("error_entities", "total_entities", digits).alias("error_entity_share"),
        "error_only_entities",
        share("error_only_entities", "total_entities", digits).alias("error_only_share"),
    )


def outcome_funnel_by_code(
    df: DataFrame, entity: str = "did", code: str = "error_code", digits: int = 5
) -> DataFrame:
    """Per positive outcome code: rows and share of all rows, distinct entities and share of
    all entities, and entities with that code that never had a valid row (and share)."""
    c = F.col(code)
    per = df.groupBy(entity, code).agg(F.count(F.lit(1)).alias("n"))
    # One window spec (same partitioning and order) for both columns: one sort, one operator.
    by_entity = Window.partitionBy(entity).orderBy(c.asc_nulls_first())
    whole = by_entity.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.select(
        entity,
        code,
        "n",
        F.max((c == 0).cast("int")).over(whole).alias("has_valid"),
        (F.row_number().over(by_entity) == 1).cast("long").alias("first"),
    )
    # Totals as one scalar subquery over the same per-entity table (its exchanges are reused).
    totals = per.agg(
        F.struct(F.sum("n").alias("total_rows"), F.sum("first").alias("total_entities"))
    ).scalar()
    by_code = (
        per.where(c > 0)
        .groupBy(code)
        .agg(
            F.sum("n").alias("n_rows"),
            F.count(F.lit(1)).alias("n_entities"),
            F.count(F.when(F.col("has_valid") == 0, F.lit(1))).alias("never_valid_entities"),
        )
    )
    total_rows, total_entities = totals["total_rows"], totals["total_entities"]
    return by_code.select(
        code,
        "n_rows",
        share("n_rows", total_rows, digits).alias("row_share"),
        "n_entities",
        share("n_entities", total_entities, digits).alias("entity_share"),
        "never_valid_entities",
        share("never_valid_entities", total_entities, digits).alias("never_valid_share"),
    )
