"""Corpus preparation: documents in, packed training sequences out.

The stages run in order; each one's result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``; columns beyond those pass through unchanged.

quality       documents that a rule or their host's verdict rejects go
near_dedup    one document of each near-duplicate component stays, the one with the smallest id
substrings    words of 50-word passages that an earlier document has go; a text that lost words is its kept words joined by
              one space and its ``n_chars`` is counted anew, any other text stays as it is
mixing        a document is emitted as many times as the mix of its source takes it
packing       pieces of at most 4096 tokens with their sequence and offset
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelson.llm import minhash, mixing, packing, quality, substring
from keelson.session import materialize


def _apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list]:
    """``docs`` with names that no operator's result has, the new names, and the columns that restore the old ones."""
    names = {c: f"_c{i}_{c}" for i, c in enumerate(docs.columns)}
    return docs.withColumnsRenamed(names), names, [F.col(n).alias(c) for c, n in names.items()]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apart, names, back = _apart(docs)
    return quality.quality_rules(apart, names["text"], names["source"]).where("kept").select(*back)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.drop_near_duplicates(docs)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    apart, names, back = _apart(docs)
    mixed = mixing.mix(mixing.sized(apart, names["text"]), names["source"], names["doc_id"]).where("copies > 0")
    each = mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return each.select(*back)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("substrings", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: MinHash components and packing are not stated in SQL. The operators of the stages are tested against brute force, the run for its shape.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage_{name}")
    return docs
