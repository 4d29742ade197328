"""Value counts, distinct entities, penetration and label-rate reports.

All counts treat null as a value of its own and count entities as groups (a null entity is one
entity), which is what ``groupBy`` does; ``count_distinct`` would skip nulls and is not used.
Every report is one plan: a map-side partial aggregate, one shuffle on the grouping key, and
small final aggregates. Multi-column reports ``unpivot`` into a long (feature, value) layout
instead of running one job per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.numeric import share


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per distinct value of ``column`` (null included): ``(column, cnt)``."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))


def as_text(column: str, kind: str | None) -> Column:
    """The column as string, with one zero for floats."""
    c = F.col(column)
    return (c + F.lit(0.0).cast(kind) if kind in ("float", "double") else c).cast("string")


def long_layout(
    df: DataFrame, columns: Sequence[str], name: str = "feature", value: str = "value", keep: Sequence[str] = ()
) -> DataFrame:
    """Unpivot ``columns`` (cast to string) into ``(keep..., name, value)``; nulls are kept, -0.0 is 0.0."""
    cols = list(columns)
    if not cols:
        raise ValueError("no columns to unpivot")
    kinds = dict(df.dtypes)
    cast = df.select(*keep, *[as_text(c, kinds.get(c)).alias(c) for c in cols])
    return cast.unpivot(list(keep), cols, name, value)


def value_type(column: str, kind: str) -> Column:
    """What a value is, apart from its text: ``integer``, ``number``, ``string``, ``boolean``, ``null``, ``object`` and ``array`` (in VARIANT
    columns, row by row) or the column's type. A JSON null is a null."""
    c = F.col(column)
    if kind == "variant":
        shape = F.schema_of_variant(c)
        named = (
            F.when(shape.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "integer")
            .when(shape.rlike("^(DECIMAL|DOUBLE|FLOAT)"), "number")
            .when(shape == "VOID", "null")
            .otherwise(F.lower(F.regexp_extract(shape, "^[A-Z_]+", 0)))
        )
    else:
        plain = {"tinyint": "integer", "smallint": "integer", "int": "integer", "bigint": "integer", "float": "number", "double": "number"}
        named = F.lit("number" if kind.startswith("decimal") else plain.get(kind, kind))
    return F.when(c.isNull(), "null").otherwise(named)


def multi_value_counts(
    df: DataFrame, columns: Sequence[str], batch_size: int | None = None, typed: bool = False
) -> DataFrame:
    """Rows per ``(feature, value)`` for many columns in one job and one scan; with ``typed`` per ``(feature, value, value_type)``, so
    that ``1``, ``"1"`` and ``true`` are values of their own also within a VARIANT column.

    ``batch_size`` unpivots very wide column lists in two steps, batches of columns and then the columns of a batch,
    so that no single expansion is wider than the batch or the number of batches.
    """
    cols = list(columns)
    keys = ["feature", "value"] + ["value_type"] * typed
    if not typed and (batch_size is None or batch_size >= len(cols)):
        return long_layout(df, cols).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    kinds = dict(df.dtypes)
    batch_size = batch_size or len(cols)

    def pair(c: str) -> Column:
        kind = [value_type(c, kinds[c]).alias("value_type")] if typed else []
        return F.struct(F.lit(c).alias("feature"), as_text(c, kinds[c]).alias("value"), *kind)

    batches = [F.array(*[pair(c) for c in cols[i : i + batch_size]]) for i in range(0, len(cols), batch_size)]
    long = df.select(F.explode(F.array(*batches)).alias("_b")).select(F.explode("_b").alias("_p")).select("_p.*")
    return long.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """D3 values: the distinct values of ``column`` (null is one value)."""
    return df.select(column).distinct()


def distinct_entities(df: DataFrame, column: str, approx: bool = False, rsd: float = 0.01) -> DataFrame:
    """D3 count: one row ``(n_entities)``, the null group counted once.

    ``approx=True`` uses a HyperLogLog++ sketch (relative standard deviation ``rsd``) instead
    of a distinct shuffle; the null group is added when present, as in the exact count.
    """
    if approx:
        c = F.col(column)
        return df.agg(
            (F.approx_count_distinct(c, rsd) + F.max(c.isNull().cast("int"))).cast("long").alias("n_entities")
        )
    return df.select(column).distinct().agg(F.count(F.lit(1)).alias("n_entities"))


def rows_and_entities(df: DataFrame, entity: str) -> DataFrame:
    """One row ``(n_rows, n_entities)`` from one shuffle on the entity."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("r"))
    return per.agg(F.sum("r").alias("n_rows"), F.count(F.lit(1)).alias("n_entities")).select(
        F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), "n_entities"
    )


def penetration_by_entity(
    df: DataFrame, feature: str, value, entities: Sequence[str] = ("did", "session_id"), digits: int = 5
) -> DataFrame:
    """Share of rows with ``feature == value`` and, per entity column, the share of distinct
    entities that have at least one such row.

    Output ``(measure, total, selected, penetration)``: measure ``rows`` plus one row per entity
    column. A null feature never matches.
    """
    ents = list(entities)
    flag = F.coalesce(F.col(feature) == F.lit(value), F.lit(False)).cast("int")
    flagged = df.select(*ents, flag.alias("hit"))
    # One pass: per (entity column, id) the rows, hits and whether any row hit; the row-level
    # measure is the sum over the ids of the first entity column, so no second scan is needed.
    per = (
        long_layout(flagged, ents, name="measure", value="id", keep=["hit"])
        .groupBy("measure", "id")
        .agg(F.count(F.lit(1)).alias("r"), F.sum("hit").alias("h"), F.max("hit").alias("any"))
        .groupBy("measure")
        .agg(
            F.count(F.lit(1)).alias("total"),
            F.sum("any").cast("long").alias("selected"),
            F.sum("r").cast("long").alias("rows"),
            F.sum("h").cast("long").alias("hits"),
        )
    )
    own = F.struct(F.col("measure"), F.col("total"), F.col("selected"))
    row_level = F.struct(F.lit("rows").alias("measure"), F.col("rows").alias("total"), F.col("hits").alias("selected"))
    out = per.select(
        F.explode(F.when(F.col("measure") == ents[0], F.array(own, row_level)).otherwise(F.array(own))).alias("m")
    ).select("m.*")
    return out.select("measure", "total", "selected", share("selected", "total", digits).alias("penetration"))


def event_label_rates(df: DataFrame, labels: Sequence[str], event: str = "event_name") -> DataFrame:
    """Value counts of each label column, per event name and over all rows, in one pass.

    Output ``(scope, event_name, label, value, cnt)`` with scope ``event`` (per event name; a null
    event name is a group of its own) or ``all`` (event_name null). The per-event row count is
    the sum of ``cnt`` over the values of any one label.
    """
    long = long_layout(df, labels, name="label", value="value", keep=[event])
    agg = long.groupingSets([[event, "label", "value"], ["label", "value"]], event, "label", "value").agg(
        F.count(F.lit(1)).alias("cnt"), F.grouping_id().alias("gid")
    )
    return agg.select(
        F.when(F.col("gid") == 0, F.lit("event")).otherwise(F.lit("all")).alias("scope"),
        F.col(event).alias("event_name"),
        "label",
        "value",
        "cnt",
    )


def outcome_code_report(df: DataFrame, code: str, names: dict[int, str], digits: int = 5) -> DataFrame:
    """Named outcome codes with their row count and share of all rows.

    ``names`` is a code -> description lookup (a handful of rows, broadcast); codes outside it
    count in the total only. The total is a scalar subquery over the counts, not a second scan.
    """
    spark = df.sparkSession
    lookup = spark.createDataFrame(list(names.items()), f"{code} int, description string")
    counts = value_counts(df, code)
    total = counts.agg(F.sum("cnt")).scalar()
    return (
        counts
        .join(F.broadcast(lookup), code)
        .select(code, "description", "cnt", share("cnt", total, digits).alias("share"))
    )


def value_topk(df: DataFrame, column: str, n: int, digits: int = 5) -> DataFrame:
    """The ``n`` most frequent values with count and share of all rows (ties by value).
    ``orderBy(...).limit(n)`` plans as a per-partition top-n merged once (TakeOrdered); the
    total is a scalar subquery over the counts."""
    counts = value_counts(df, column)
    total = counts.agg(F.sum("cnt")).scalar()
    top = counts.orderBy(F.col("cnt").desc(), F.col(column).asc_nulls_last()).limit(n)
    return top.select(column, "cnt", share("cnt", total, digits).alias("share"))
