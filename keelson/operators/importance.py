"""Feature importance from a decision tree fitted on Spark (``pyspark.ml``), with the test-side
confusion counts. Training and scoring stay distributed; only the fitted model's importance
vector (one number per feature) reaches the driver.

The split into train / test is the hash split of ``keelson.operators.sampling`` (80/20 by
default), so it is reproducible. Tree depth is bounded (Spark's limit is 30), unlike an
unbounded single-machine tree, so importances are comparable in ranking, not in value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.functions.numeric import share
from keelson.operators.ordered import running_totals
from keelson.operators.sampling import balance_then_sample, with_split
from keelson.session import materialize


def feature_importance(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    weights: Sequence[float] = (0.8, 0.2),
    key=None,
    max_depth: int = 10,
    seed: int = 3,
) -> DataFrame:
    """Report ``(section, name, value)``: section ``importance`` has one row per feature
    (importance, descending ranks in ``rank``), section ``confusion`` has tp, fp, fn, tn,
    precision and recall on the test part (label 1 = positive), and section ``skipped`` the labelled rows of each
    part that the tree could not take since a feature is null or NaN.

    The labelled rows and their split are written once to the shared folder; the fit, the scoring and the counts read that.
    Without training rows there are no importances and the counts are 0."""
    feats = list(features)
    data = df.select(*feats, F.col(label).cast("double").alias("_label"), *([key] if isinstance(key, str) else []))
    data = data.where(F.col("_label").isin(0.0, 1.0))
    doubles = [F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(feats)]
    usable = ~F.exists(F.array(*doubles), lambda x: x.isNull() | F.isnan(x))
    named = with_split(data, weights, key=key).select("split", "_label", *doubles, usable.alias("_usable"))
    split = materialize(named, "importance_rows")
    skipped = split.agg(
        *[F.count(F.when((F.col("split") == p) & ~F.col("_usable"), 1)).cast("double").alias(p) for p in ("train", "test")]
    ).unpivot([], ["train", "test"], "name", "value")
    skipped = skipped.select(F.lit("skipped").alias("section"), "name", "value", F.lit(None).cast("int").alias("rank"))
    split = split.where("_usable")
    assembler = VectorAssembler(inputCols=[f"_f{i}" for i in range(len(feats))], outputCol="_features")
    train = assembler.transform(split.where(F.col("split") == "train"))
    test = assembler.transform(split.where(F.col("split") == "test"))
    tree = DecisionTreeClassifier(
        featuresCol="_features", labelCol="_label", maxDepth=max_depth, seed=seed, cacheNodeIds=False
    )
    model = tree.fit(train) if train.limit(1).count() else None
    spark = df.sparkSession
    imp = model.featureImportances.toArray().tolist() if model else []
    ranked = sorted(zip(feats, imp), key=lambda x: (-x[1], x[0]))
    importance = spark.createDataFrame(
        [("importance", f, float(v), i + 1) for i, (f, v) in enumerate(ranked)],
        "section string, name string, value double, rank int",
    )
    pred = (model.transform(test) if model else test.withColumn("prediction", F.lit(0.0)).limit(0)).select("_label", "prediction")
    y, p = F.col("_label") == 1.0, F.col("prediction") == 1.0
    counts = pred.agg(
        F.count(F.when(y & p, 1)).alias("tp"),
        F.count(F.when(~y & p, 1)).alias("fp"),
        F.count(F.when(y & ~p, 1)).alias("fn"),
        F.count(F.when(~y & ~p, 1)).alias("tn"),
    )
    metrics = counts.select(
        F.col("tp").cast("double").alias("tp"),
        F.col("fp").cast("double").alias("fp"),
        F.col("fn").cast("double").alias("fn"),
        F.col("tn").cast("double").alias("tn"),
        share("tp", F.col("tp") + F.col("fp"), None).alias("precision"),
        share("tp", F.col("tp") + F.col("fn"), None).alias("recall"),
    )
    confusion = metrics.unpivot([], ["tp", "fp", "fn", "tn", "precision", "recall"], "name", "value").select(
        F.lit("confusion").alias("section"), "name", "value", F.lit(None).cast("int").alias("rank")
    )
    return importance.unionByName(confusion).unionByName(skipped)


def split_gains(df: DataFrame, features: Sequence[str], label: str = "label", partitions: int | None = None) -> DataFrame:
    """The exact best first split of each feature: ``(feature, threshold, gain, n_left, n_right)``, the left side being
    ``feature <= threshold``.

    ``gain`` is the fall of the Gini impurity; a tree's first split is on the feature with the largest. Labelled rows (0 / 1) count;
    nulls and NaN of a feature are left out of its own split. Ties go to the smallest threshold; a feature with
    one value has no row. Counts per distinct value are summed up over range slices, so no task sees a whole feature.
    """
    c = F.col(label)
    known = df.where(c.isin(0, 1)).select(c.cast("double").alias("_label"), *[F.col(f).cast("double").alias(f) for f in features])
    long = known.unpivot(["_label"], list(features), "feature", "value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    per = long.groupBy("feature", (F.col("value") + F.lit(0.0)).alias("value")).agg(
        F.count(F.lit(1)).alias("cnt"), F.sum("_label").cast("long").alias("pos")
    )
    ranked = running_totals(per, ["feature"], "value", ["cnt", "pos"], partitions)
    a, p = F.col("cum_cnt").cast("double"), F.col("cum_pos").cast("double")
    b, q = F.col("tot_cnt") - a, F.col("tot_pos") - p
    n, m = F.col("tot_cnt").cast("double"), F.col("tot_pos").cast("double")
    pure = (p * p + (a - p) * (a - p)) / a + (q * q + (b - q) * (b - q)) / b
    gain = pure / n - (m * m + (n - m) * (n - m)) / (n * n)
    cuts = ranked.where(F.col("cum_cnt") < F.col("tot_cnt"))
    best = F.max(F.struct(gain.alias("gain"), (-F.col("value")).alias("_low"), F.col("cum_cnt").alias("n_left"), F.col("tot_cnt").alias("_n")))
    found = cuts.groupBy("feature").agg(best.alias("b"))
    low = (F.lit(0.0) - F.col("b._low")).alias("threshold")
    return found.select("feature", low, "b.gain", "b.n_left", (F.col("b._n") - F.col("b.n_left")).alias("n_right"))


def importance_analysis(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    rate: Sequence[float] | None = (1, 1),
    mode: str = "sample",
    max_n: int | None = 2_000_000,
    key=None,
    **tree_kw,
) -> DataFrame:
    """Balance to ``rate``, cap at ``max_n`` rows, then ``feature_importance``.

    ``max_n`` bounds the labelled rows of the fit; ``None`` fits on all of them.
    """
    sampled = balance_then_sample(df, balance="balance", rate=rate, mode=mode, max_n=max_n, label=label, key=key)
    return feature_importance(sampled, features, label, key=key, **tree_kw)
