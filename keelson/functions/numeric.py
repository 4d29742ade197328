"""Small numeric column helpers shared by the reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def share(num: str | Column, den: str | Column, digits: int | None = 5) -> Column:
    """``num / den`` as double, null when ``den`` is 0 or null, rounded to ``digits``."""
    q = F.try_divide(_c(num).cast("double"), _c(den).cast("double"))
    q = F.when(_c(den) == 0, F.lit(None).cast("double")).otherwise(q)
    return F.round(q, digits) if digits is not None else q
