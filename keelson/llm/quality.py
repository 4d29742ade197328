"""Host-level quality rules.

Each document gets the counts of the rules from its whole text. Rule failures are aggregated by
host, each host's failure rate is shrunk towards the corpus with a beta prior fitted to all hosts
(method of moments), and the host's verdict is joined back to its documents.

DataFrame functions only. The counts are computed once and written to the shared checkpoint
folder, since both the host rates and the documents need them. Host totals are pre-aggregated before the
shuffle, so a hot host costs one row per task. The table of failing hosts is broadcast if it has
no more than ``BROADCAST_HOSTS`` rows; beyond that both sides are salted, so that one host's
documents spread over ``SALTS`` tasks.

Defined results: a null or blank text has no words and fails; a document with a null host has no
host verdict; repeated rows are judged one by one; an empty table gives an empty table. Columns of
the input that share a name with a result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import SPACE, words
from keelson.session import materialize

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A host fails when its shrunk failure rate is above this.
MAX_HOST_RATE = 0.5
#: The prior weighs as much as this many documents at least and at most.
PRIOR_MIN, PRIOR_MAX = 1.0, 10_000.0
BROADCAST_HOSTS = 100_000
SALTS = 64
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with the five counts of :data:`COUNTS` (long) and ``base_failed``."""
    keep = [c for c in df.columns if c not in (*COUNTS, "base_failed")]
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # Separate projections: a column used more than once is computed once.
    step = df.select(*keep, words(F.col(text)).alias("_q_words"), lines.alias("_q_lines"), t.alias("_q_text"))
    step = step.select(
        *keep,
        "_q_words",
        F.size("_q_words").alias("_q_n"),
        F.length(F.translate("_q_text", " \t\n\x0b\x0c\r", "")).alias("_q_chars"),
        (F.length("_q_text") - F.length(F.translate("_q_text", SYMBOLS, ""))).alias("_q_symbols"),
        (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).alias("_q_dup"),
    )
    windows = F.when(
        F.col("_q_n") > WINDOW,
        F.transform(
            F.sequence(F.lit(1), F.col("_q_n") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice(F.col("_q_words"), i, F.lit(WINDOW))),
        ),
    )
    step = step.withColumn("_q_win", windows).drop("_q_words")
    # Only a text with a repeated window sorts its windows.
    repeats = F.size("_q_win") > F.size(F.array_distinct("_q_win"))
    step = step.withColumn(
        "_q_sorted",
        F.when(
            repeats, F.array_sort(F.transform("_q_win", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        ),
    ).drop("_q_win")
    same = lambda x, j: x["h"] == F.get(F.col("_q_sorted"), j)["h"]
    step = step.withColumn(
        "_q_at",
        F.array_sort(
            F.transform(
                F.filter(
                    "_q_sorted",
                    lambda x, j: F.coalesce(same(x, j - 1), F.lit(False)) | F.coalesce(same(x, j + 1), F.lit(False)),
                ),
                lambda x: x["p"],
            )
        ),
    ).drop("_q_sorted")
    # Each repeated window covers its words up to the start of the next one.
    covered = F.aggregate(
        F.transform(
            "_q_at", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_q_at"), j + 1) - p, F.lit(WINDOW)))
        ),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    step = step.select(
        *keep,
        F.col("_q_n").cast("long").alias("n_words"),
        F.col("_q_chars").cast("long").alias("word_chars"),
        F.col("_q_symbols").cast("long").alias("n_symbols"),
        F.col("_q_dup").cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    return step.withColumn("base_failed", failed)


def host_rates(counted: DataFrame, host: str = "source") -> DataFrame:
    """One row per host: ``n``, ``failed``, ``rate`` (shrunk) and ``host_failed``."""
    hosts = (
        counted.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    )
    mean = F.sum("failed") / F.sum("n")
    square = F.sum(F.col("failed") * F.col("failed") / F.col("n")) / F.sum("n")
    moments = hosts.agg(mean.alias("m"), (square - mean * mean).alias("v"))
    weight = F.when(F.col("v") > 1e-12, F.col("m") * (1 - F.col("m")) / F.col("v") - 1).otherwise(F.lit(PRIOR_MAX))
    prior = moments.select(
        F.struct(
            F.col("m"), F.greatest(F.lit(PRIOR_MIN), F.least(F.lit(PRIOR_MAX), weight)).alias("weight")
        ).alias("prior")
    )
    rated = hosts.withColumn("prior", prior.scalar())
    rate = (F.col("failed") + F.col("prior.m") * F.col("prior.weight")) / (F.col("n") + F.col("prior.weight"))
    return rated.select("host", "n", "failed", rate.alias("rate"), (rate > MAX_HOST_RATE).alias("host_failed"))


def quality_rules(df: DataFrame, text: str = "text", host: str = "source") -> DataFrame:
    """``df`` with the counts, ``base_failed`` and ``kept``: no rule failed, nor the host."""
    return judged(materialize(rule_counts(df, text), "rule_counts"), host)


def judged(counted: DataFrame, host: str = "source", broadcast_hosts: int = BROADCAST_HOSTS) -> DataFrame:
    """Host verdicts joined back to counted documents."""
    columns = [c for c in counted.columns if c != "kept"]
    bad = host_rates(counted, host).where("host_failed").select(F.col("host").alias("_q_host"))
    bad = materialize(bad, "failed_hosts")
    if bad.count() <= broadcast_hosts:
        joined = counted.join(F.broadcast(bad), F.col(host) == F.col("_q_host"), "left")
    else:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(SALTS))
        many = bad.select("_q_host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_q_bad_salt"))
        joined = counted.withColumn("_q_salt", salt).join(
            many, (F.col(host) == F.col("_q_host")) & (F.col("_q_salt") == F.col("_q_bad_salt")), "left"
        )
    return joined.select(*columns, (~F.col("base_failed") & F.col("_q_host").isNull()).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    counted = rule_counts(docs).drop("text")
    return judged(materialize(counted, "rule_counts")).drop("source")


SQL = rf"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM split),
keyed AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM win),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM keyed) WHERE c > 1),
cover AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
base AS (
  SELECT s.doc_id, s.source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '{SPACE}', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN cover ON cover.doc_id = s.doc_id),
failing AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM base),
host AS (SELECT source, count(*) AS n, count(*) FILTER (WHERE base_failed) AS f FROM failing WHERE source IS NOT NULL GROUP BY source),
mom AS (SELECT sum(f) / sum(n) AS m, sum(f * f / n) / sum(n) - power(sum(f) / sum(n), 2) AS v FROM host),
prior AS (SELECT m, greatest({PRIOR_MIN}, least({PRIOR_MAX}, CASE WHEN v > 1e-12 THEN m * (1 - m) / v - 1 ELSE {PRIOR_MAX} END)) AS s FROM mom),
bad AS (SELECT source FROM host, prior WHERE (f + m * s) / (n + s) > {MAX_HOST_RATE})
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND (source IS NULL OR source NOT IN (SELECT source FROM bad)) AS kept
FROM failing
"""
