"""Class balancing, capped sampling, train/test split and row shuffling.

Sampling keeps a row when ``unit_hash(key, seed) < fraction`` (see
``keelson.functions.sampling``): the same rows on every run, under any partitioning and after
task retries, and reproducible in SQL. Fractions come from one label-count aggregate; they
reach the filter as a scalar subquery (binary labels), a broadcast of one row per listed event
(the caller's list bounds it), or a plain join (multi-class balancing). Rows are never collected.

``key`` names id column(s) that tell the rows apart. Rows whose key is null are told apart by their other columns; without
a key, equal rows are numbered first (``with_row_key``), which costs a shuffle.

Null semantics: rows whose label is null (or not 0/1 for the binary operators) are dropped from
every balanced output; an empty class gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keelson.functions.sampling import ROW_KEY, TWO_32, unit_hash, with_row_key

SAMPLE_SEED = 3
CAP_SEED = 5
SPLIT_SEED = 33
SHUFFLE_SEED = 42


def _u(seed: int | str) -> Column:
    return unit_hash(F.col(ROW_KEY), seed)


def _unkeyed(df: DataFrame, key) -> DataFrame:
    """Without the key column, unless the caller's own key is that column."""
    return df if key == ROW_KEY else df.drop(ROW_KEY)


def sample_fraction(df: DataFrame, fraction: float | Column, key=None, seed: int | str = SAMPLE_SEED) -> DataFrame:
    """Keep each row with probability ``fraction`` (deterministic in key and seed)."""
    frac = fraction if isinstance(fraction, Column) else F.lit(float(fraction))
    return _unkeyed(with_row_key(df, key).where(_u(seed) < frac), key)


def _binary_fractions(pos: Column, neg: Column, rate: Sequence[float]) -> tuple[Column, Column]:
    """Keep-fractions ``(neg_frac, pos_frac)`` that bring neg:pos to ``rate[0]:rate[1]`` by
    downsampling the side in excess: with r = neg/pos and t = rate[0]/rate[1], if r > t keep
    ``int(neg*t/r)/neg`` of the negatives, if r < t keep ``int(pos*r/t)/pos`` of the
    positives; equal ratios keep everything. An empty side keeps nothing."""
    t = F.lit(float(rate[0]) / float(rate[1]))
    r = neg.cast("double") / pos.cast("double")
    empty = (pos == 0) | (neg == 0)
    neg_take = F.floor(neg.cast("double") * (t / r)).cast("double") / neg.cast("double")
    pos_take = F.floor(pos.cast("double") * (r / t)).cast("double") / pos.cast("double")
    one, zero = F.lit(1.0), F.lit(0.0)
    neg_frac = F.when(empty, zero).when(r > t, neg_take).otherwise(one)
    pos_frac = F.when(empty, zero).when(r < t, pos_take).otherwise(one)
    return neg_frac, pos_frac


def _label_counts(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    lab = F.col(label)
    return df.groupBy(*by).agg(
        F.count(F.when(lab == 1.0, F.lit(1))).alias("_pos"),
        F.count(F.when(lab == 0.0, F.lit(1))).alias("_neg"),
    )


def _keep_binary(label: str) -> Column:
    lab, u = F.col(label), F.col("_u")
    return ((lab == 1.0) & (u < F.col("_pos_frac"))) | ((lab == 0.0) & (u < F.col("_neg_frac")))


_TMP = ["_u", "_neg_frac", "_pos_frac", "_frac"]


def balance_to_ratio(
    df: DataFrame, rate: Sequence[float] = (1, 1), label: str = "label", key=None, seed: int | str = SAMPLE_SEED
) -> DataFrame:
    """Downsample whichever of the 0/1 classes exceeds the wanted ``neg:pos`` ratio."""
    counts = _label_counts(df, label)
    neg_frac, pos_frac = _binary_fractions(F.col("_pos"), F.col("_neg"), rate)
    fr = counts.select(F.struct(neg_frac.alias("neg"), pos_frac.alias("pos"))).scalar()
    keyed = with_row_key(df, key)
    hashed = keyed.select("*", _u(seed).alias("_u"), fr["neg"].alias("_neg_frac"), fr["pos"].alias("_pos_frac"))
    return _unkeyed(hashed.where(_keep_binary(label)).drop(*_TMP), key)


def balance_by_fractions(
    df: DataFrame, fractions: Sequence[float], label: str = "label", key=None, seed: int | str = SAMPLE_SEED
) -> DataFrame:
    """Keep the given fractions ``[neg, pos]`` of each class (no counting)."""
    neg, pos = (float(x) for x in fractions)
    lab = F.col(label)
    u = _u(seed)
    keep_neg = F.lit(True) if neg == 1 else u < F.lit(neg)
    keep_pos = F.lit(True) if pos == 1 else u < F.lit(pos)
    return _unkeyed(with_row_key(df, key).where(((lab == 1.0) & keep_pos) | ((lab == 0.0) & keep_neg)), key)


def balance_to_minority(df: DataFrame, label: str, key=None, seed: int | str = SAMPLE_SEED) -> DataFrame:
    """Keep the rarest class whole (ties: smallest value) and sample every other class
    down to its size. Null labels are dropped."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_cnt"))
    base = counts.orderBy("_cnt", label).limit(1).select(F.struct(F.col("_cnt").alias("m"), F.col(label).alias("b"))).scalar()
    # One plan for any number of classes: a shuffle join, or a broadcast if AQE finds the fractions small.
    fr = counts.select(
        label, F.when(F.col(label) == base["b"], 1.0).otherwise(base["m"] / F.col("_cnt")).alias("_frac")
    )
    keyed = with_row_key(df, key)
    kept = keyed.withColumn("_u", _u(seed)).join(fr, label).where((F.col("_u") < F.col("_frac")) | (F.col("_frac") == 1.0))
    return kept.select(*df.columns)


def sample_to_cap(
    df: DataFrame,
    max_n: int | None,
    mode: str = "sample",
    n: int | None = None,
    key=None,
    seed: int | str = CAP_SEED,
    exact: bool = False,
) -> DataFrame:
    """When ``mode == 'sample'`` and the row count exceeds ``max_n``, keep ``max_n / count``
    of the rows. A known count ``n`` skips counting; otherwise the count is a scalar subquery
    evaluated once and used as a value in the filter. ``exact`` keeps exactly ``max_n`` rows: those of the
    smallest hashes, ties by key."""
    if mode != "sample" or max_n is None:
        return df
    if n is not None and max_n >= n:
        return df
    if exact:
        return _unkeyed(_smallest_hashes(with_row_key(df, key), int(max_n), seed), key)
    if n is not None:
        return sample_fraction(df, float(max_n) / float(n), key, seed)
    total = df.agg(F.count(F.lit(1))).scalar()
    frac = F.when(total > max_n, F.lit(float(max_n)) / total.cast("double"))
    return _unkeyed(with_row_key(df, key).where(frac.isNull() | (_u(seed) < frac)), key)


def _smallest_hashes(df: DataFrame, m: int, seed: int | str) -> DataFrame:
    """The ``m`` rows of smallest hash. The hash of the m-th row is found from two histograms of at most 65,536
    rows each (its high, then its low 16 bits); only rows of exactly that hash are ordered, by key."""
    if m <= 0:
        return df.limit(0)
    hashed = df.withColumn("_h", (_u(seed) * F.lit(TWO_32)).cast("long"))
    high, low = F.shiftright("_h", 16), F.col("_h").bitwiseAND(65535)

    def at_rank(rows: DataFrame, part: Column, rank: Column):
        """The part that holds the rank, and the rows before it."""
        counts = rows.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
        upto = counts.withColumn("_s", F.sum("_c").over(Window.orderBy("_p")))
        hit = upto.where((F.col("_s") >= rank) & (F.col("_s") - F.col("_c") < rank))
        return hit.select(F.struct("_p", (F.col("_s") - F.col("_c")).alias("before"))).scalar()

    first = at_rank(hashed, high, F.lit(m))
    second = at_rank(hashed.where(high == first["_p"]), low, F.lit(m) - first["before"])
    bound = first["_p"] * 65536 + second["_p"]
    left = F.lit(m) - first["before"] - second["before"]
    # Fewer rows than asked: no bound, all rows stay.
    below = hashed.where(bound.isNull() | (F.col("_h") < bound)).drop("_h")
    at = hashed.where(F.col("_h") == bound).withColumn("_r", F.row_number().over(Window.orderBy(ROW_KEY)))
    return below.unionByName(at.where(F.col("_r") <= left).drop("_h", "_r"))


def balance_then_sample(
    df: DataFrame,
    balance: str = "unbalance",
    rate: Sequence[float] | None = (5, 1),
    mode: str = "sample",
    max_n: int | None = None,
    label: str = "label",
    fractions: Sequence[float] | None = None,
    n: int | None = None,
    key=None,
    seed: int | str = SAMPLE_SEED,
    cap_seed: int | str = CAP_SEED,
    exact: bool = False,
) -> DataFrame:
    """E5: balance (ratio, or explicit fractions) then cap. ``balance='unbalance'`` cancels the
    ratio but not explicit fractions; with neither, all rows pass, whatever their label. There is no
    cap unless ``max_n`` is given; it hashes with its own seed so it is independent of the balancing draw."""
    if balance == "unbalance":
        rate = None
    if fractions is None and rate is None and (max_n is None or mode != "sample"):
        return df
    keyed = with_row_key(df, key)
    if fractions is not None:
        keyed = balance_by_fractions(keyed, fractions, label, ROW_KEY, seed)
    elif rate is not None:
        keyed = balance_to_ratio(keyed, rate, label, ROW_KEY, seed)
    return _unkeyed(sample_to_cap(keyed, max_n, mode, n, ROW_KEY, cap_seed, exact), key)


def with_split(
    df: DataFrame, weights: Sequence[float] = (0.8, 0.2), names: Sequence[str] = ("train", "test"), key=None,
    seed: int | str = SPLIT_SEED, column: str = "split",
) -> DataFrame:
    """E6 core: adds ``split`` from cumulative normalised weights on an independent hash (one
    name per weight; the last part takes the rest)."""
    if len(weights) != len(names) or not weights:
        raise ValueError("give one name per split weight")
    total = float(sum(weights))
    u = _u(seed)
    acc, expr = 0.0, None
    for i, (w, name) in enumerate(zip(weights, names)):
        acc += float(w) / total
        cond = u < F.lit(acc) if i < len(weights) - 1 else F.lit(True)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return _unkeyed(with_row_key(df, key).withColumn(column, expr), key)


def split_train_test(df: DataFrame, weights: Sequence[float] = (0.8, 0.2), key=None, **balance_kw) -> DataFrame:
    """Balance and sample (E5), then label each row ``train`` or ``test``."""
    sampled = balance_then_sample(with_row_key(df, key), key=ROW_KEY, **balance_kw)
    return _unkeyed(with_split(sampled, weights, key=ROW_KEY), key)


def balance_per_event(
    df: DataFrame,
    events: Sequence[str],
    rate: Sequence[float] = (1, 1),
    label: str = "label",
    event: str = "event_name",
    key=None,
    seed: int | str = SAMPLE_SEED,
) -> DataFrame:
    """Balance inside each listed event; an event with fewer than two label values passes
    unbalanced (its 0/1 rows kept whole)."""
    uniq = list(dict.fromkeys(events))
    sel = df.where(F.col(event).isin(uniq))
    counts = _label_counts(sel, label, by=[event])
    pos, neg = F.col("_pos"), F.col("_neg")
    neg_frac, pos_frac = _binary_fractions(pos, neg, rate)
    single = (pos == 0) | (neg == 0)
    fr = counts.select(
        event,
        F.when(single, F.lit(1.0)).otherwise(neg_frac).alias("_neg_frac"),
        F.when(single, F.lit(1.0)).otherwise(pos_frac).alias("_pos_frac"),
    )
    # One row per listed event: size fixed by the caller's list.
    hashed = with_row_key(sel, key).withColumn("_u", _u(seed))
    kept = hashed.join(F.broadcast(fr), event).where(_keep_binary(label)).drop(*_TMP)
    return _unkeyed(kept, key).select(*df.columns)


def balance_total(
    df: DataFrame,
    events: Sequence[str],
    rate: Sequence[float] = (1, 1),
    label: str = "label",
    event: str = "event_name",
    key=None,
    seed: int | str = SAMPLE_SEED,
) -> DataFrame:
    """Select the listed events, then balance over all of them together."""
    uniq = list(dict.fromkeys(events))
    return balance_to_ratio(df.where(F.col(event).isin(uniq)), rate, label, key, seed)


def shuffle_rows(df: DataFrame, key=None, seed: int | str = SHUFFLE_SEED, partitions: int | None = None) -> DataFrame:
    """Global pseudo-random order, deterministic in key and seed.

    The hash is uniform, so the bounds of the ranges are known: a row's partition is computed, and no job samples the input for them."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    keyed = with_row_key(df, key)
    placed = keyed.repartitionById(n, F.floor(_u(seed) * n).cast("int"))
    return _unkeyed(placed.sortWithinPartitions(_u(seed), ROW_KEY), key)
