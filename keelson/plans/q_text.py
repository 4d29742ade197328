"""Queries: article text extraction (J) over the ``articles`` view (rich-content documents and
pages with spliced platform markup) and raw ``pages``."""

from __future__ import annotations


from keelson.functions import text as T
from keelson.operators import text as J
from keelson.plans import oracle_text as O
from keelson.plans.catalog import register
from keelson.plans.oracle_views import with_views
from keelson.plans.views import articles, html_articles, rich_articles, spread, table

ART = with_views("articles")


def _rich_sql(c: str) -> str:
    pat = O.sql_str(O.RICH_FALLBACK)
    return (
        f"coalesce(CASE WHEN json_valid({c}) THEN json_extract_string({c}, '{T.RICH_TEXT_PATH}') END, "
        f"CASE WHEN regexp_matches({c}, {pat}) THEN regexp_extract({c}, {pat}, 1) END)"
    )


_PLATFORM = O.steps_sql("content", O.PLATFORM_STEPS)
_CLEAN = (
    f"CASE WHEN contains(content, '{T.RICH_MARKER}') THEN {_rich_sql('content')} "
    f"ELSE {O.steps_sql(_PLATFORM, O.STRIP_HTML_STEPS)} END"
)
_ROUTE = f"CASE WHEN contains(content, '{T.RICH_MARKER}') THEN 'rich' ELSE 'html' END"


@register(
    "clean_articles",
    ART + f"SELECT article_id, {_ROUTE} AS route, t AS text, t IS NOT NULL AS ok "
    f"FROM (SELECT article_id, content, {_CLEAN} AS t FROM articles)",
)
def q_clean_articles(spark, sf_dir):
    return J.clean_articles(articles(spark, sf_dir))


@register("rich_text", ART + f"SELECT article_id, {_rich_sql('content')} AS text FROM articles")
def q_rich_text(spark, sf_dir):
    return J.extract(articles(spark, sf_dir), "rich_text")


@register("strip_platform_markup", ART + f"SELECT article_id, {_PLATFORM} AS text FROM articles")
def q_strip_platform_markup(spark, sf_dir):
    return J.extract(articles(spark, sf_dir), "strip_platform_markup")


@register("strip_html", f"SELECT page_id, {O.steps_sql('html', O.STRIP_HTML_STEPS)} AS text FROM pages")
def q_strip_html(spark, sf_dir):
    return J.extract(spread(table(spark, sf_dir, "pages")), "strip_html", content="html", key="page_id")


_MD = O.steps_sql(O.steps_sql("content", O.MARKDOWN_STEPS), O.MEDIA_STEPS)


@register(
    "html_to_text",
    ART + f"SELECT article_id, {_MD} AS text FROM articles WHERE NOT contains(content, '{T.RICH_MARKER}')",
)
def q_html_to_text(spark, sf_dir):
    # Same rows as the non-rich part of the article view, read from the pages branch alone.
    return J.extract(spread(html_articles(spark, sf_dir)), "html_to_text")


_FLAT = f"replace(replace({_MD}, chr(10), ''), '\\\\\\', '')"


@register(
    "html_json_to_text",
    ART + f"SELECT article_id, CASE WHEN json_valid(f) THEN json_extract_string(f, '{T.RICH_TEXT_PATH}') END AS text "
    f"FROM (SELECT article_id, {_FLAT} AS f FROM articles WHERE contains(content, '{T.RICH_MARKER}'))",
)
def q_html_json_to_text(spark, sf_dir):
    # Same rows as the rich part of the article view, read from the documents branch alone.
    return J.extract(spread(rich_articles(spark, sf_dir)), "html_json_to_text")


@register(
    "clean_articles_report",
    ART + f"""SELECT route, count(*) AS n_rows, count(CASE WHEN t IS NULL THEN 1 END) AS n_failed,
       CAST(coalesce(sum(length(content)), 0) AS BIGINT) AS chars_in,
       CAST(coalesce(sum(length(t)), 0) AS BIGINT) AS chars_out
FROM (SELECT content, {_ROUTE} AS route, {_CLEAN} AS t FROM articles) GROUP BY route""",
)
def q_clean_articles_report(spark, sf_dir):
    return J.clean_articles_report(articles(spark, sf_dir))


@register(
    "clean_articles_stream",
    ART + f"SELECT article_id, {_ROUTE} AS route, t AS text, t IS NOT NULL AS ok "
    f"FROM (SELECT article_id, content, {_CLEAN} AS t FROM articles)",
)
def q_clean_articles_stream(spark, sf_dir):
    """The same cleaning as a Structured Streaming job: the article table is written as input
    files under the scratch folder, streamed through ``clean_articles`` (available-now trigger,
    checkpointed) into a Parquet sink, and the sink is read back."""
    from keelson.session import scratch_path
    from keelson.streaming.stateless import clean_articles_stream

    src, sink = scratch_path(spark, "articles-in"), scratch_path(spark, "articles-out")
    articles(spark, sf_dir).write.parquet(src)
    query = clean_articles_stream(spark, src, sink)
    query.awaitTermination()
    if query.exception() is not None:
        raise RuntimeError(str(query.exception()))
    return spark.read.parquet(sink).select("article_id", "route", "text", "ok")
