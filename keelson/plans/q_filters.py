"""Queries: selections (B) and session / entity joins (C) on the feed."""

from __future__ import annotations

from pyspark.sql import functions as F

from keelson.operators import filters as B
from keelson.operators import sessions as S
from keelson.plans.catalog import register
from keelson.plans.oracle_views import with_views
from keelson.plans.views import feed, table

FEED = with_views("feed")
FEED_CLASSES = {0: "old", 1: "new", 2: "unknown"}


@register("select_flagged", FEED + "SELECT * FROM feed WHERE enter_app = true")
def q_select_flagged(spark, sf_dir):
    return B.select_flagged(feed(spark, sf_dir), "with_enter_app", flag="enter_app", name="enter_app")


@register("select_user_class", FEED + "SELECT * FROM feed WHERE user_class = 'new'")
def q_select_user_class(spark, sf_dir):
    return B.select_user_class(feed(spark, sf_dir), 1, column="user_class", classes=FEED_CLASSES)


@register(
    "unknown_class_values",
    FEED
    + "SELECT user_class, count(*) AS cnt FROM feed WHERE user_class IS NULL OR user_class NOT IN ('old', 'new') "
    "GROUP BY user_class",
)
def q_unknown_class_values(spark, sf_dir):
    return B.unknown_class_values(feed(spark, sf_dir), column="user_class", classes={0: "old", 1: "new"})


@register("select_events", FEED + "SELECT * FROM feed WHERE event_name IN ('purchase', 'signup')")
def q_select_events(spark, sf_dir):
    return B.select_events(feed(spark, sf_dir), ["purchase", "signup", "purchase"])


@register("select_value_rows", "SELECT * FROM lineitem WHERE l_returnflag = 'R'")
def q_select_value_rows(spark, sf_dir):
    return B.select_value_rows(table(spark, sf_dir, "lineitem"), "l_returnflag", "R")


@register(
    "outcome_split",
    FEED
    + "SELECT *, CASE WHEN error_code = 0 THEN 'valid' WHEN error_code > 0 THEN 'error' END AS outcome FROM feed",
)
def q_outcome_split(spark, sf_dir):
    return B.outcome_split(feed(spark, sf_dir), "error_code")


def _anti(cond: str) -> str:
    return (
        FEED
        + f"SELECT f.* FROM feed f WHERE NOT EXISTS (SELECT 1 FROM feed b WHERE {cond} AND b.session_id = f.session_id)"
    )


@register("drop_sessions_below", _anti("b.value < 1"))
def q_drop_sessions_below(spark, sf_dir):
    return S.drop_sessions_below(feed(spark, sf_dir), "value", 1.0)


@register("drop_sessions_above", _anti("b.value > 200"))
def q_drop_sessions_above(spark, sf_dir):
    return S.drop_sessions_above(feed(spark, sf_dir), "value", 200.0)


@register(
    "keep_sessions_with",
    FEED
    + "SELECT f.* FROM feed f WHERE EXISTS "
    "(SELECT 1 FROM feed b WHERE b.event_name = 'purchase' AND b.session_id = f.session_id)",
)
def q_keep_sessions_with(spark, sf_dir):
    return S.keep_sessions_with(feed(spark, sf_dir), "event_name", "purchase")


@register(
    "entities_only_in",
    FEED
    + "SELECT session_id FROM feed WHERE error_code > 0 EXCEPT SELECT session_id FROM feed WHERE error_code = 0",
)
def q_entities_only_in(spark, sf_dir):
    f = feed(spark, sf_dir)
    return S.entities_only_in(f.where(F.col("error_code") > 0), f.where(F.col("error_code") == 0), "session_id")
