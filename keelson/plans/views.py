"""Derived input views built from the driver tables (Spark side).

Every view here has a twin SQL text in ``keelson.plans.oracle_views`` that computes the same
rows in DuckDB; the checker and ``oracle_sql()`` rely on that equivalence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt row by row over the shuffle partitions: splits of files follow compressed bytes and row groups, so
    without it a few tasks can hold all rows that are dear to clean."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


# Outcome codes of the feed: one per event type (fixed values of the fixture).
EVENT_CODES = [("view", 0), ("click", 401), ("signup", 402), ("purchase", 403), ("error", 1000)]


def _props_k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event log / prediction log with labels, flags, sessions and outcome codes."""
    k = F.col("k")
    code = F.lit(None).cast("int")
    for name, value in reversed(EVENT_CODES):
        code = F.when(F.col("event_type") == name, F.lit(value)).otherwise(code)
    dt = F.date_format("ts", "yyyyMMdd")
    return (
        table(spark, sf_dir, "events")
        .withColumn("k", _props_k())
        .select(
            "event_id",
            F.when(k == 13, F.lit(None).cast("bigint")).otherwise(F.col("user_id")).alias("did"),
            F.concat(F.col("user_id").cast("string"), F.lit("-"), dt).alias("session_id"),
            dt.alias("dt"),
            F.col("event_type").alias("event_name"),
            code.alias("error_code"),
            "value",
            F.least(F.col("value") / F.lit(500.0), F.lit(1.0)).alias("predict"),
            F.when(k == 7, F.lit(None).cast("double"))
            .when(k % 5 == 0, F.lit(1.0))
            .otherwise(F.lit(0.0))
            .alias("label"),
            F.when(k == 11, F.lit(None).cast("boolean")).otherwise(k % 3 == 0).alias("enter_app"),
            F.when(k < 60, "old").when(k < 90, "new").otherwise("unknown").alias("user_class"),
        )
    )


DENSE_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def dense_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*DENSE_COLUMNS)


SPARSE_FEED_COLUMNS = ["event_name", "user_class", "label", "enter_app", "dt", "did"]
SPARSE_PART_COLUMNS = ["p_brand", "p_type", "p_size", "p_name"]
SPARSE_ORDER_COLUMNS = ["o_orderstatus", "o_orderpriority"]


def ordered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of every line item."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return lines.join(part, lines["l_partkey"] == part["p_partkey"])


def _brand_counts(rows: DataFrame) -> DataFrame:
    counts = rows.groupBy(F.col("p_brand").alias("value")).agg(F.count(F.lit(1)).alias("cnt"))
    return counts.select(F.lit("p_brand").alias("feature"), "value", "cnt")


def vocab_old(spark: SparkSession, sf_dir: str, slots: int = 10) -> DataFrame:
    """Positional vocabulary: the top ``slots`` brands of ``part`` plus the next one as the
    reserved last slot."""
    from keelson.operators.ordered import top_k_per_group

    order = [F.col("cnt").desc(), F.col("value").asc_nulls_last()]
    top = top_k_per_group(_brand_counts(table(spark, sf_dir, "part")), ["feature"], order, slots + 1, rank="_r")
    return top.select("feature", F.col("_r").cast("long").alias("position"), "value")


def vocab_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brand frequencies among the ordered parts."""
    return _brand_counts(ordered_parts(spark, sf_dir))


# Invented platform markup spliced into pages (fixture values, see FIXTURES.md section 4).
SPLICE_MARKUP = [
    '<span class="sub-title" data-x="1">Sub\ntitle</span>',
    '<a class="author-name-link pgc-link" href="/u/1">Author\nName</a>',
    '<div class="tt-title">Headline</div>',
    '{!-- PGC_VIDEO:{"vid":"v1","duration":12.5} --}',
    "<header>Kept header</header><link rel='x' href='y'>",
    "It&#8217;s &#x27;so&#x27; &#128512; &#0; &#55296; &eacute;t&Eacute; &amp;lt; &amp;#39; &bogus; & &#; R&D &nbsp;&#160;x",
    "one" + '<br class="c">' * 10_000 + "two",
    "<a class='l' href='/u/2'>A <b>bold</b> link</a> <a href=\"/u/3\"><em>x</em></a>",
]


def rich_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rich-content JSON payloads: all documents, wrapped as ``{"rich_content": {"text": ..., "spans": []}}``, once
    escaped and once as they are (not JSON where the text has quotes or line breaks)."""
    docs = table(spark, sf_dir, "documents")
    raw = docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("-raw")).alias("article_id"),
        F.concat(F.lit('{"rich_content":{"text":"'), F.col("text"), F.lit('","spans":[]}}')).alias("content"),
    )
    escaped = docs.select(
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("article_id"),
        F.to_json(
            F.struct(
                F.struct(
                    F.col("text").alias("text"),
                    F.array().cast("array<string>").alias("spans"),
                ).alias("rich_content")
            )
        ).alias("content"),
    )
    return escaped.unionByName(raw)


def html_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw pages with platform markup spliced in after ``<body>`` in turn by
    ``page_id``."""
    pages = table(spark, sf_dir, "pages")
    markup = F.lit(None).cast("string")
    for i, m in reversed(list(enumerate(SPLICE_MARKUP))):
        markup = F.when(F.col("page_id") % len(SPLICE_MARKUP) == i, F.lit(m)).otherwise(markup)
    spliced = F.replace(F.col("html"), F.lit("<body>"), F.concat(F.lit("<body>"), markup))
    return pages.select(
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("article_id"),
        spliced.alias("content"),
    )


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Article payloads of both kinds: rich-content documents and pages with markup, mixed in every partition."""
    return spread(rich_articles(spark, sf_dir).unionByName(html_articles(spark, sf_dir)))
