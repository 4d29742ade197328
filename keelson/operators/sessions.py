"""Session filters and entity set differences as semi / anti joins.

The set of offending sessions is derived by a distinct aggregate and joined back, never
collected into a literal list: the plan size stays fixed whatever the number of sessions. AQE
turns the join into a broadcast hash join when the session set turns out small at run time, and
splits a skewed (hot) session on the large side otherwise.

Null semantics: a row with a null session belongs to no session, so an anti join keeps it and a
semi join drops it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _sessions_where(df: DataFrame, cond, session: str) -> DataFrame:
    return df.where(cond).select(session).where(F.col(session).isNotNull()).distinct()


def _without(df: DataFrame, bad: DataFrame, session: str) -> DataFrame:
    """Rows outside the sessions ``bad``. Rows without a session pass beside the join, so they are not shuffled as one key."""
    null = F.col(session).isNull()
    return df.where(~null).join(bad, session, "left_anti").select(*df.columns).unionByName(df.where(null))


def drop_sessions_below(df: DataFrame, feature: str, min_value, session: str = "session_id") -> DataFrame:
    """Remove every row of any session having a row with ``feature < min_value``."""
    return _without(df, _sessions_where(df, F.col(feature) < F.lit(min_value), session), session)


def drop_sessions_above(df: DataFrame, feature: str, max_value, session: str = "session_id") -> DataFrame:
    """Remove every row of any session having a row with ``feature > max_value``."""
    return _without(df, _sessions_where(df, F.col(feature) > F.lit(max_value), session), session)


def keep_sessions_with(df: DataFrame, feature: str, value, session: str = "session_id") -> DataFrame:
    """Keep every row of sessions having at least one row with ``feature == value``."""
    good = _sessions_where(df, F.col(feature) == F.lit(value), session)
    return df.join(good, session, "left_semi")


def entities_only_in(a: DataFrame, b: DataFrame, entity: str) -> DataFrame:
    """Distinct entities of ``a`` that are not in ``b`` (set semantics: null equals null)."""
    # Distinct on both sides first: a hot entity is one row per map task before the shuffle.
    return a.select(entity).distinct().subtract(b.select(entity).distinct())
