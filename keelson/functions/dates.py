"""``yyyyMMdd`` day strings as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_FORMAT = "yyyyMMdd"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def to_day(x: str | Column) -> Column:
    return F.to_date(_c(x), DAY_FORMAT)


def day_text(d: Column) -> Column:
    return F.date_format(d, DAY_FORMAT)


def date_shift(day: str | Column, n: int | Column) -> Column:
    """``yyyyMMdd`` plus ``n`` days (negative ``n`` goes back)."""
    nn = n if isinstance(n, Column) else F.lit(n)
    return day_text(F.date_add(to_day(day), nn))


def day_sequence(start: str | Column, end: str | Column) -> Column:
    """Array of all days from ``start`` to ``end`` inclusive as ``yyyyMMdd``; empty when
    ``start > end`` (a reversed range never counts down)."""
    a, b = to_day(start), to_day(end)
    days = F.sequence(a, b, F.expr("INTERVAL 1 DAY"))
    return F.when(a <= b, F.transform(days, day_text)).otherwise(F.array().cast("array<string>"))
