"""Article cleaning jobs over a table of payloads (narrow projections: no shuffle except the
per-route report).

Each row is routed by content: payloads mentioning the rich-content key are read as JSON
(``rich``), everything else has its platform markup removed and is stripped of HTML (``html``).
A row whose extraction yields null is a failure; ``clean_articles`` keeps it (``ok`` false) so a
caller can split failures off without a second pass.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions import text as T


def _cleaned(df: DataFrame, content: str, keep) -> DataFrame:
    return df.select(*keep, T.route(content).alias("route"), T.clean_article(content).alias("text"))


def clean_articles(df: DataFrame, content: str = "content", key: str = "article_id") -> DataFrame:
    """``(key, route, text, ok)`` for every payload."""
    return _cleaned(df, content, [key]).withColumn("ok", F.col("text").isNotNull())


def clean_articles_report(df: DataFrame, content: str = "content") -> DataFrame:
    """Per route: rows, failures (null text), characters before and after cleaning."""
    cleaned = _cleaned(df.withColumn("_in", F.length(content)), content, ["_in"]).select(
        "route", "_in", F.length("text").alias("_out")
    )
    return cleaned.groupBy("route").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count(F.when(F.col("_out").isNull(), F.lit(1))).alias("n_failed"),
        F.coalesce(F.sum("_in"), F.lit(0)).cast("long").alias("chars_in"),
        F.coalesce(F.sum("_out"), F.lit(0)).cast("long").alias("chars_out"),
    )


def extract(df: DataFrame, how: str, content: str = "content", key: str = "article_id") -> DataFrame:
    """``(key, text)`` with one extraction: ``rich_text``, ``strip_platform_markup``,
    ``strip_html``, ``html_to_text`` or ``html_json_to_text``."""
    fn = {
        "rich_text": T.rich_text,
        "strip_platform_markup": T.strip_platform_markup,
        "strip_html": T.strip_html,
        "html_to_text": T.html_to_text,
        "html_json_to_text": T.html_json_to_text,
    }[how]
    return df.select(key, fn(content).alias("text"))
