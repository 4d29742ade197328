"""Score metrics: ROC AUC, confusion counts at fixed thresholds, threshold penetration.

Threshold sweeps never loop over thresholds: each row gets a bin number (how many thresholds
its score passes, a sum of comparisons inside the projection), rows are counted per bin in one
aggregate, and the per-threshold numbers are sums over bins (a 21 x 22 table). AUC ranks
distinct scores with ``running_totals`` (range-partitioned, no single-task window).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keelson.functions.numeric import share
from keelson.operators.ordered import running_totals

# 21 evenly spaced thresholds from 0 to 1. The confusion sweep uses them as
# computed (0.15000000000000002, ...), the penetration sweep rounded to 4 places.
CONFUSION_THRESHOLDS: list[float] = np.linspace(0.0, 1.0, 21).tolist()
PENETRATION_THRESHOLDS: list[float] = [round(t, 4) for t in CONFUSION_THRESHOLDS]


def _bin(score: Column, thresholds: Sequence[float], strict: bool) -> Column:
    """Number of thresholds the score passes (``>`` when strict, else ``>=``); null score -> 0, and
    NaN -> 0 when strict (Spark orders NaN above every number, so ``>`` alone would pass it)."""
    terms = [F.when(((score > F.lit(t)) & ~F.isnan(score)) if strict else (score >= F.lit(t)), F.lit(1)).otherwise(F.lit(0)) for t in thresholds]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total


def auc(df: DataFrame, score: str = "predict", label: str = "label", digits: int = 4,
        partitions: int | None = None) -> DataFrame:
    """Area under the ROC curve with ties counted half: one row ``(auc, n_pos, n_neg)``.

    Rows with a null score or a label other than 0/1 are ignored. Equal to the share of
    (positive, negative) pairs ranked correctly, ties counting 1/2.
    """
    lab, s = F.col(label), F.col(score)
    per = (
        df.where(s.isNotNull() & lab.isin(0.0, 1.0))
        .groupBy(score)
        .agg(
            F.count(F.when(lab == 1.0, F.lit(1))).alias("pos"),
            F.count(F.when(lab == 0.0, F.lit(1))).alias("neg"),
        )
        .withColumn("_g", F.lit(0))
    )
    ranked = running_totals(per, ["_g"], score, ["neg"], partitions)
    below = F.col("cum_neg") - F.col("neg")
    term = F.col("pos").cast("double") * (F.lit(2.0) * below.cast("double") + F.col("neg").cast("double"))
    agg = ranked.agg(
        F.sum(term).alias("_s"),
        F.coalesce(F.sum("pos"), F.lit(0)).cast("long").alias("n_pos"),
        F.coalesce(F.sum("neg"), F.lit(0)).cast("long").alias("n_neg"),
    )
    # Null (not an error) when a class is absent.
    value = F.try_divide(F.col("_s"), F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double"))
    return agg.select(F.round(value, digits).alias("auc"), "n_pos", "n_neg")


def threshold_confusion(
    df: DataFrame,
    score: str = "predict",
    label: str = "label",
    thresholds: Sequence[float] = CONFUSION_THRESHOLDS,
    digits: int = 4,
) -> DataFrame:
    """Per threshold (``score > threshold`` predicts positive): TP, FP, FN, TN, accuracy
    (rounded), precision and recall (null when undefined), label and prediction totals.
    Rows with a label other than 0/1 are ignored; a null score predicts negative."""
    lab = F.col(label)
    bins = (
        df.where(lab.isin(0.0, 1.0))
        .select(_bin(F.col(score), thresholds, strict=True).alias("bin"), (lab == 1.0).cast("int").alias("y"))
        .groupBy("bin")
        .agg(F.sum("y").cast("long").alias("p"), F.count(F.lit(1)).alias("n"))
    )
    # Bin b passes thresholds 0..b-1, so it is predicted positive at threshold i iff b > i. One
    # global aggregate over the (<= 22) bin rows gives every threshold at once, also on empty input.
    b, p, n = F.col("bin"), F.col("p"), F.col("n")
    zero = F.lit(0).cast("long")

    def total(expr):
        return F.coalesce(F.sum(expr), zero).cast("long")

    sums = []
    for i in range(len(thresholds)):
        sums += [
            total(F.when(b > i, p)).alias(f"tp{i}"),
            total(F.when(b > i, n - p)).alias(f"fp{i}"),
            total(F.when(b <= i, p)).alias(f"fn{i}"),
            total(F.when(b <= i, n - p)).alias(f"tn{i}"),
        ]
    per_th = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(t)).alias("threshold"),
                    *[F.col(f"{m}{i}").alias(m) for m in ("tp", "fp", "fn", "tn")],
                )
                for i, t in enumerate(thresholds)
            ]
        )
    )
    g = bins.agg(*sums).select(per_th.alias("_t")).select("_t.*")
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select(
        "threshold", "tp", "fp", "fn", "tn",
        share(tp + tn, tp + fp + fn + tn, digits).alias("accuracy"),
        share(tp, tp + fp, None).alias("precision"),
        share(tp, tp + fn, None).alias("recall"),
        (tp + fn).alias("label_pos"), (fp + tn).alias("label_neg"),
        (tp + fp).alias("pred_pos"), (fn + tn).alias("pred_neg"),
    )


def threshold_penetration(
    df: DataFrame,
    score: str = "predict",
    entity: str = "did",
    population: int | DataFrame | None = None,
    thresholds: Sequence[float] = PENETRATION_THRESHOLDS,
    digits: int = 5,
) -> DataFrame:
    """Per threshold, rows with ``score >= threshold`` and entities with at least one such
    row (= entities whose max score passes), as counts and shares of all rows, all entities
    and an external population (count, or a frame whose row count is used)."""
    # One scan and one shuffle (on the entity, after map-side partial aggregation): per entity,
    # the rows passing each threshold and the highest bin reached (bins are monotone in the
    # score, so that is the bin of the max score). One global aggregate then gives every
    # threshold at once; no branch of the plan is evaluated twice.
    k = len(thresholds)
    b = F.col("_bin")
    per = (
        df.select(entity, _bin(F.col(score), thresholds, strict=False).alias("_bin"))
        .groupBy(entity)
        .agg(
            F.max(b).alias("_mb"),
            F.count(F.lit(1)).alias("_rt"),
            *[F.count(F.when(b > i, F.lit(1))).alias(f"_r{i}") for i in range(k)],
        )
    )
    tot = per.agg(
        F.coalesce(F.sum("_rt"), F.lit(0)).cast("long").alias("total_rows"),
        F.count(F.lit(1)).alias("total_entities"),
        *[F.coalesce(F.sum(f"_r{i}"), F.lit(0)).cast("long").alias(f"_nr{i}") for i in range(k)],
        *[F.count(F.when(F.col("_mb") > i, F.lit(1))).alias(f"_ne{i}") for i in range(k)],
    )
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(t)).alias("threshold"),
                    F.col(f"_nr{i}").alias("n_rows"),
                    F.col(f"_ne{i}").alias("n_entities"),
                )
                for i, t in enumerate(thresholds)
            ]
        )
    )
    g = tot.select("total_rows", "total_entities", rows.alias("_t")).select(
        "_t.threshold", "_t.n_rows", "_t.n_entities", "total_rows", "total_entities"
    )
    if isinstance(population, DataFrame):
        pop_col = population.agg(F.count(F.lit(1))).scalar()
    else:
        pop_col = F.lit(population).cast("long")
    return g.select(
        "threshold", "n_rows", share("n_rows", "total_rows", digits).alias("row_share"),
        "n_entities", share("n_entities", "total_entities", digits).alias("entity_share"),
        share(F.col("n_entities"), pop_col, digits).alias("population_share"),
    )
