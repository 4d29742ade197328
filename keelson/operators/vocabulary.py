"""Refresh fixed-length positional vocabularies from new value frequencies.

Rule, per feature, for an old vocabulary of length L whose last slot is reserved:
- the reserved slot keeps its value and position; that value is removed from the candidates;
- an old value (slots 1..L-1) that is still a candidate keeps its position;
- the other slots are gaps, filled left to right with the remaining candidates (candidates not
  already kept) in frequency order (count desc, value asc, nulls last);
- when candidates run out a gap keeps its old value; surplus candidates are dropped.
So the length never changes. Values are compared null-safely and must be unique per feature. Where the vocabulary has a
``value_type``, a value is its text and its type, so the number ``1`` and the text ``"1"`` are two.

Plan: old slots and candidates are united and grouped once by (feature, value), which tells reserved, matched,
free and missing values apart. Candidates that occur several times in ``new`` count together. Only the first ``L - 1``
free candidates of a feature can fill a gap, so their ranking is a top-k per feature, whatever the column's
cardinality; gaps and fillers, both bounded by the vocabulary's length, meet on (feature, rank). Nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keelson.operators.counts import multi_value_counts
from keelson.operators.ordered import top_k_per_group
from keelson.session import materialize


def vocabulary_merge(old: DataFrame, new: DataFrame) -> DataFrame:
    """``old``: ``(feature, position, value)`` positions 1..L per feature; ``new``:
    ``(feature, value, cnt)`` candidate frequencies. Returns ``(feature, position, value)``. With ``value_type`` in both, it belongs
    to the value and is returned too."""
    if ("value_type" in old.columns) != ("value_type" in new.columns):
        raise ValueError("value_type in one of the tables only")
    same = ["value", "value_type"] if "value_type" in old.columns else ["value"]
    last = Window.partitionBy("feature")
    none = F.lit(None).cast("long")
    slot = F.struct(F.col("position").cast("long").alias("position"), (F.col("position") == F.col("_L")).alias("last"))
    sized = old.select("feature", "position", *same, F.max("position").over(last).alias("_L"))
    sized = materialize(sized, "vocabulary")  # features x length rows; two branches and the length read it
    slots = sized.select("feature", *same, none.alias("cnt"), slot.alias("_slot"))
    cands = new.select("feature", *same, F.col("cnt").cast("long").alias("cnt")).withColumn("_slot", F.lit(None).cast(slots.schema["_slot"].dataType))
    # One row per value: its count and its old slots (collect_list skips nulls; a vocabulary's length bounds it).
    values = (
        slots.unionByName(cands)
        .groupBy("feature", *same)
        .agg(F.sum("cnt").alias("cnt"), F.collect_list("_slot").alias("_slots"))
        .withColumn("_cand", F.col("cnt").isNotNull() & ~F.exists("_slots", lambda s: s["last"]))
    )
    taken = values.where(F.size("_slots") > 0).select("feature", *same, "_cand", F.inline("_slots"))
    gap = ~(F.col("last") | F.col("_cand"))
    by_position = Window.partitionBy("feature", gap).orderBy("position")
    slots = taken.select("feature", "position", *same, F.when(gap, F.row_number().over(by_position)).alias("_r"))

    # One number, the largest vocabulary length, is read ahead: a top-k takes a literal.
    k = sized.agg(F.max("_L")).first()[0] or 1
    by_freq = [F.col("cnt").desc(), *[F.col(c).asc_nulls_last() for c in same]]
    free = values.where(F.col("_cand") & (F.size("_slots") == 0)).select("feature", *same, "cnt")
    ranked = top_k_per_group(free, ["feature"], by_freq, max(k - 1, 0), rank="_r")
    # A null candidate is a value too, so the match flag, not the value, decides.
    fillers = ranked.select("feature", "_r", *[F.col(c).alias(f"_new_{c}") for c in same], F.lit(True).alias("_hit"))
    merged = [F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in same]
    return slots.join(fillers, ["feature", "_r"], "left").select("feature", "position", *merged)


def vocabulary_refresh(df: DataFrame, features: Sequence[str], vocab: DataFrame) -> DataFrame:
    """Refresh the vocabularies of ``features`` from current value counts of ``df`` (no
    minimum share). ``vocab`` is ``(feature, position, value)``, values comparing as strings, or
    ``(feature, position, value, value_type)``, values comparing with their type."""
    kind = ["value_type"] if "value_type" in vocab.columns else []
    counts = multi_value_counts(df, features, typed=bool(kind))
    old = vocab.where(F.col("feature").isin(list(features))).select(
        "feature", "position", F.col("value").cast("string").alias("value"), *kind
    )
    return vocabulary_merge(old, counts)
