"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words: space and the five controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Stands for a null id, which counts as larger than every other id.
NULL_ID = (1 << 63) - 1


def words(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != F.lit(""))


def give_back() -> None:
    """Give freed memory back to the system: Python workers are reused, and what an idle one holds counts for its executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def parts(df: DataFrame, column: str, bytes_per_part: int) -> int:
    """How many parts of about ``bytes_per_part`` bytes the column's values fill, 1 at least."""
    total = df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0]
    return max(1, -(-int(total or 0) // bytes_per_part))
