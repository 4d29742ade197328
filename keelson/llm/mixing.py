"""Mixing sources to target weights by systematic sampling.

Source sizes are summed over all documents. Sources in code point order, null last, get the
weights in turn; a share of all sizes is dealt out by weight, no source getting more than ``MOST``
times its size, the excess going to the others by weight (the water level at which the capped
amounts add up to the total). Within a source every document expects ``target / source_size``
copies; the running sum of the expected copies, moved by one random offset of the source, crosses some
integers in each document, and it is emitted once for each.

Documents are taken in the order of their size, which stratifies the sample: the words taken
differ from the target by about the size of the largest document at most. The running sum is
``rank * expectation``, so only ranks are needed. They come from range slices of (source, size, id)
written once to the shared checkpoint folder: a hot source spreads over many slices, and a table of
counts per slice gives the offsets. The offset is a hash of the seed and the source, so reruns agree.

DataFrame functions only. Defined results: a null text has size 0; documents of size 0 take part
and add no words; null sources form one source, the last; a source with no words has target 0 and
no copies; repeated rows are separate documents; rows of one source, size and id are ranked by a hash of all columns; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keelson.llm.common import WORD
from keelson.operators.ordered import running_totals
from keelson.session import materialize

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 17
ADDED = ("size", "source_size", "target", "copies", "taken")


def sized(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``size``, the number of words of the whole text (long)."""
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD))
    return df.withColumn("size", n.cast("long"))


def source_targets(sizes: DataFrame, source: str, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source (null included): ``source_size``, ``target``.

    Places in the order of sources and totals in the order of cap / weight are running totals over range slices, so no task holds
    all sources; the water level is one number.
    """
    per = sizes.groupBy(F.col(source).alias("_m_source")).agg(F.sum("size").alias("source_size"))
    named = (F.col("_m_source").isNull().alias("_m_null"), F.col("_m_source").alias("_m_name"))  # null last
    per = running_totals(per.withColumns({"_m_key": F.struct(*named), "_m_one": F.lit(1)}), [], "_m_key", ["_m_one"])
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("cum__m_one") - 1, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("_m_source", "source_size", turn.alias("_m_weight"), (F.col("source_size") * F.lit(float(most))).alias("_m_cap"))
    # Sources fill up in the order of cap / weight: those before the water level stop at their cap.
    per = per.withColumn("_m_fill", F.struct((F.col("_m_cap") / F.col("_m_weight")).alias("at"), *named))
    per = running_totals(per, [], "_m_fill", ["_m_weight", "_m_cap", "source_size"])
    left = F.col("tot_source_size") * F.lit(share) - (F.col("cum__m_cap") - F.col("_m_cap"))
    x = left / (F.col("tot__m_weight") - (F.col("cum__m_weight") - F.col("_m_weight")))
    first = per.agg(F.min(F.when(F.col("_m_fill.at") > x, F.struct("_m_fill", x.alias("x"))))["x"]).first()[0]
    target = F.col("_m_cap")
    if first is not None:
        target = F.when(F.col("_m_fill.at") > F.lit(first), F.col("_m_weight") * F.lit(first)).otherwise(target)
    return per.select("_m_source", "source_size", target.alias("target"))


def mix(df: DataFrame, source: str = "source", doc_id: str = "doc_id", seed: int = SEED) -> DataFrame:
    """``df``, which has ``size``, with :data:`ADDED`: ``copies`` says how often to emit each row."""
    keep = [c for c in df.columns if c not in ADDED]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    # Rows that share source, size and id take the order of a hash of all their columns, so reruns rank them alike.
    unhashed = (T.MapType, T.VariantType)
    own = F.xxhash64(*[F.col(c) for c in keep if not isinstance(df.schema[c].dataType, unhashed)])
    keys = [F.col(source).asc_nulls_last(), F.col("size").desc(), F.col(doc_id).asc_nulls_last(), F.col("_m_own")]
    sliced = df.select(*keep, "size").withColumn("_m_own", own).repartitionByRange(n, *keys).withColumn("_m_slice", F.spark_partition_id())
    sliced = materialize(sliced, "mix_slices")  # range bounds are sampled: all uses read one evaluation
    targets = source_targets(sliced, source)
    per = sliced.groupBy(F.col(source).alias("_m_source"), F.col("_m_slice").alias("_m_s")).agg(F.count(F.lit(1)).alias("_m_n"))
    before = Window.partitionBy("_m_source").orderBy("_m_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.withColumn("_m_off", F.coalesce(F.sum("_m_n").over(before), F.lit(0))).drop("_m_n")
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("_m_source"), F.lit("\0")))), 1, 8), 16, 10)
    # One row per source and slice it touches: sources + slices rows, not a row per document.
    plan = materialize(
        offsets.join(targets.withColumnRenamed("_m_source", "_m_t"), F.col("_m_source").eqNullSafe(F.col("_m_t")))
        .withColumn("_m_u", u.cast("double") / F.lit(4294967296.0))
        .drop("_m_t"),
        "mix_plan",
    )
    local = Window.partitionBy(source, "_m_slice").orderBy(*keys[1:])
    ranked = sliced.withColumn("_m_rank", F.row_number().over(local)).join(
        plan, F.col(source).eqNullSafe(F.col("_m_source")) & (F.col("_m_slice") == F.col("_m_s"))
    )
    rank = F.col("_m_rank") + F.col("_m_off")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    crossed = F.floor(F.col("_m_u") + each * rank) - F.floor(F.col("_m_u") + each * (rank - 1))
    return ranked.select(*keep, "size", "source_size", "target", crossed.cast("long").alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size")
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(sized(docs.select("doc_id", "source", "text")).drop("text")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight,
             {MOST}.0::DOUBLE * source_size AS cap FROM s),
f AS (SELECT *, cap / weight AS fill FROM w),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () * {SHARE}
                 - coalesce(sum(cap) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level,
             row_number() OVER (ORDER BY fill, source NULLS LAST) AS spot FROM f),
m AS (SELECT arg_min(level, spot) AS level FROM l WHERE fill > level),
t AS (SELECT source, source_size, CASE WHEN (SELECT level FROM m) IS NULL OR fill <= (SELECT level FROM m) THEN cap
                                       ELSE weight * (SELECT level FROM m) END AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS each,
             row_number() OVER (PARTITION BY d.source ORDER BY d.size DESC, d.doc_id) AS k,
             ('0x' || substr(md5('{SEED}:' || coalesce(d.source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(u + each * k) - floor(u + each * (k - 1)) AS BIGINT) * size AS taken
FROM r
"""
