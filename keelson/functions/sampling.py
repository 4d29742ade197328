"""Deterministic per-row uniform numbers for sampling and splitting.

``unit_hash(key, seed)`` = first 32 bits of ``md5("<seed>:<key>")`` / 2^32, in [0, 1). A row's
fate depends only on its key and the seed, never on partitioning or task retries, so a sample
or split is the same on every run, after an executor loss, and in DuckDB:
``CAST(('0x' || substr(md5('<seed>:' || key), 1, 8)) AS UBIGINT) / 4294967296``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TWO_32 = 4294967296.0

#: Name of the column that ``with_row_key`` adds.
ROW_KEY = "_row_key"

#: Copies of one row that are numbered together when there is no key.
_CHUNK = 4096


def _whole_row(columns: Sequence[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS"})


def row_key(columns: Sequence[str] | str, all_columns: Sequence[str]) -> Column:
    """The sampling key: the given id column(s) as text. A row whose id columns are all null takes
    the whole row as JSON instead, so such rows don't share one fate."""
    columns = [columns] if isinstance(columns, str) else list(columns)
    if len(columns) == 1:
        return F.coalesce(F.col(columns[0]).cast("string"), _whole_row(all_columns))
    joined = F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    return F.when(F.coalesce(*[F.col(c).cast("string") for c in columns]).isNull(), _whole_row(all_columns)).otherwise(joined)


def with_row_key(df: DataFrame, columns: Sequence[str] | str | None) -> DataFrame:
    """``df`` with its sampling key in ``ROW_KEY``.

    The id column(s) must tell the rows apart: rows of equal key share one fate. Without any, equal
    rows are counted (with a partial count before the shuffle) and given out again with a copy number, which joins the row's
    JSON in the key; numbers are dealt in chunks over the partitions, so a row with many copies doesn't stay in one task.
    """
    if columns == ROW_KEY:
        return df
    if columns is not None:
        return df.withColumn(ROW_KEY, row_key(columns, df.columns))
    names = df.columns
    counted = df.groupBy(*[F.col(f"`{c}`") for c in names]).agg(F.count(F.lit(1)).alias("_n"))
    chunks = counted.withColumn(ROW_KEY, _whole_row(names)).withColumn(
        "_chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / _CHUNK)))
    )
    first = F.col("_chunk") * _CHUNK
    last = F.least(first + _CHUNK, F.col("_n"))
    copies = chunks.repartition(F.col(ROW_KEY), F.col("_chunk")).withColumn(
        "_copy", F.explode(F.sequence(first + 1, last))
    )
    key = F.concat_ws(":", F.col(ROW_KEY), F.col("_copy").cast("string"))
    return copies.select(*[F.col(f"`{c}`") for c in names], key.alias(ROW_KEY))


def unit_hash(key: Column, seed: int | str) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), key))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(TWO_32)


def unit_hash_sql(key_sql: str, seed: int | str) -> str:
    """DuckDB text of ``unit_hash`` for a key expression already of type VARCHAR."""
    return f"(CAST(('0x' || substr(md5('{seed}:' || {key_sql}), 1, 8)) AS UBIGINT) / CAST({int(TWO_32)} AS DOUBLE))"
