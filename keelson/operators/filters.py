"""Row selections by flag, class, event name, value and outcome (stateless, pushed to the scan)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The hashed user-class codes the selection binds to by default
# (0 = old user, 1 = new user, 2 = value missing).
DEFAULT_USER_CLASSES = {
    0: "1441316838565839423",
    1: "1441154329194859489",
    2: "1441400840757033267",
}


def select_flagged(df: DataFrame, mode: str, flag: str = "enter_app_info", name: str = "enter_app") -> DataFrame:
    """Rows by a boolean flag: ``mix`` = all rows, ``with_<name>`` = flag true,
    ``without_<name>`` = flag false (null flags are in neither). Other modes raise."""
    if mode == "mix":
        return df
    if mode == f"with_{name}":
        return df.where(F.col(flag) == F.lit(True))
    if mode == f"without_{name}":
        return df.where(F.col(flag) == F.lit(False))
    raise ValueError(f"unknown selection mode {mode!r}")


def select_user_class(
    df: DataFrame, code: int | None, column: str = "is_newuser", classes: dict[int, str] | None = None
) -> DataFrame:
    """Rows of one user class by code (0 old, 1 new, 2 missing); any other code keeps all rows."""
    classes = DEFAULT_USER_CLASSES if classes is None else classes
    if code not in classes:
        return df
    return df.where(F.col(column) == F.lit(classes[code]))


def unknown_class_values(
    df: DataFrame, column: str = "is_newuser", classes: dict[int, str] | None = None
) -> DataFrame:
    """Values of the class column outside the known set (null included), with row counts."""
    known = list((DEFAULT_USER_CLASSES if classes is None else classes).values())
    c = F.col(column)
    return df.where(c.isNull() | ~c.isin(known)).groupBy(column).agg(F.count(F.lit(1)).alias("cnt"))


def select_events(df: DataFrame, names: Sequence[str], event: str = "event_name") -> DataFrame:
    """Rows whose event name is in ``names`` (one scan; duplicate names do not duplicate rows)."""
    uniq = list(dict.fromkeys(names))
    return df.where(F.col(event).isin(uniq))


def select_value_rows(df: DataFrame, feature: str, value) -> DataFrame:
    """Rows where ``feature`` equals ``value``."""
    return df.where(F.col(feature) == F.lit(value))


def outcome_split(df: DataFrame, code: str = "error_code", out: str = "outcome") -> DataFrame:
    """Adds ``outcome``: ``valid`` for code 0, ``error`` for a positive code, else null."""
    c = F.col(code)
    return df.withColumn(out, F.when(c == 0, F.lit("valid")).when(c > 0, F.lit("error")))


def existing_features(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """Split requested feature names into those present as columns and those missing
    (a schema check: no job runs)."""
    cols = set(df.columns)
    present = [f for f in features if f in cols]
    missing = [f for f in features if f not in cols]
    return present, missing


def require_features(df: DataFrame, features: Sequence[str], ignore_missing: bool = False) -> list[str]:
    present, missing = existing_features(df, features)
    if missing and not ignore_missing:
        raise ValueError(f"missing feature columns: {missing}")
    return present
