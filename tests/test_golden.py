"""Golden micro-tables for the null / NaN / tie / empty rules and the hand-checked edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keelson.functions.dates import date_shift, day_sequence
from keelson.operators import counts as C
from keelson.operators import quantiles as Q
from keelson.operators import sampling as E
from keelson.operators import sessions as S
from keelson.operators import thresholds as T
from keelson.operators import vocabulary as V
from keelson.operators.ordered import running_totals


# --- counts ---------------------------------------------------------------------------------
def test_value_counts_null_nan_and_signed_zero(spark):
    df = spark.createDataFrame([(x,) for x in [1.0, 1.0, 2.0, None, float("nan"), float("nan"), 0.0, -0.0]], "v double")
    got = {(None if r.v is None else ("nan" if math.isnan(r.v) else r.v)): r.cnt for r in C.value_counts(df, "v").collect()}
    assert got == {1.0: 2, 2.0: 1, None: 1, "nan": 2, 0.0: 2}


def test_multi_value_counts_keeps_nulls(spark):
    df = spark.createDataFrame([("a", 1), ("a", None), (None, None)], "s string, i int")
    got = {(r.feature, r.value): r.cnt for r in C.multi_value_counts(df, ["s", "i"], batch_size=1).collect()}
    assert got == {("s", "a"): 2, ("s", None): 1, ("i", "1"): 1, ("i", None): 2}


def test_distinct_entities_counts_null_once(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "d int")
    assert C.distinct_entities(df, "d").first().n_entities == 3
    r = C.rows_and_entities(df, "d").first()
    assert (r.n_rows, r.n_entities) == (5, 3)


# --- sessions -------------------------------------------------------------------------------
def test_session_filters_null_semantics(spark):
    df = spark.createDataFrame(
        [("s1", 0.5), ("s1", 5.0), ("s2", 5.0), (None, 0.1), (None, 7.0)], "session_id string, v double"
    )
    key = lambda t: (t[0] or "", t[1])
    kept = sorted(((r.session_id, r.v) for r in S.drop_sessions_below(df, "v", 1.0).collect()), key=key)
    # s1 goes (it has a row below 1); null-session rows belong to no session and stay
    assert kept == [(None, 0.1), (None, 7.0), ("s2", 5.0)]
    with_hi = [(r.session_id, r.v) for r in S.keep_sessions_with(df, "v", 7.0).collect()]
    assert with_hi == []  # the only 7.0 row has a null session: no session qualifies
    only = sorted(r.session_id or "-" for r in S.entities_only_in(df, df.where("v > 1"), "session_id").collect())
    assert only == []


def test_entities_only_in_treats_null_as_equal(spark):
    a = spark.createDataFrame([(1,), (None,), (3,)], "e int")
    b = spark.createDataFrame([(None,), (3,)], "e int")
    assert [r.e for r in S.entities_only_in(a, b, "e").collect()] == [1]


# --- percentiles ----------------------------------------------------------------------------
@pytest.mark.parametrize(
    "values",
    [
        [5.0],
        [1.0, 2.0],
        [3.0, 1.0, 2.0, 2.0, 2.0, 9.0, 7.0],
        [float(x) for x in range(101)],
        [0.0, -1.0, 2.5, 2.5, 2.5, 4.0, 10.0, 10.0, 0.0, 3.0, 8.0, 8.0, 8.0],
        [float(x % 7) * 1.5 for x in range(57)],
    ],
)
def test_midpoint_percentiles_match_numpy(spark, values):
    df = spark.createDataFrame([(v, None) for v in values] + [(None, None), (float("nan"), None)], "x double, y double")
    got = {
        (r.variant, r.percentile): r.value
        for r in Q.percentiles_midpoint(df, ["x", "y"], partitions=3).collect()
        if r.feature == "x"
    }
    for variant, arr in (("all", np.array(values)), ("positive", np.array([v for v in values if v > 0]))):
        if arr.size == 0:
            assert not any(k[0] == variant for k in got)
            continue
        want = np.percentile(arr, Q.DEFAULT_PERCENTILES, method="midpoint")
        for p, w in zip(Q.DEFAULT_PERCENTILES, want):
            assert got[(variant, float(p))] == pytest.approx(float(w), rel=0, abs=1e-12)


def test_percentiles_all_nonpositive_has_no_positive_variant(spark):
    df = spark.createDataFrame([(0.0,), (-2.0,), (0.0,)], "x double")
    rows = Q.percentiles_midpoint(df, ["x"]).collect()
    assert {r.variant for r in rows} == {"all"}
    assert Q.dense_map_exact(df, ["x"]).count() == 0


def test_discrete_quantiles_match_spark_percentile_disc(spark):
    vals = [float(v) for v in [3, 1, 4, 1, 5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9]]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    cum = Q.ranked_values(Q.numeric_long(df, ["x"]), partitions=4)
    got = {r.quantile: r.value for r in Q.discrete_quantiles(cum, ["x"], (0.1, 0.5, 0.95)).collect()}
    want = df.agg(
        *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY x)").alias(str(q)) for q in (0.1, 0.5, 0.95)]
    ).first()
    assert got == {0.1: want["0.1"], 0.5: want["0.5"], 0.95: want["0.95"]}


def test_approx_dense_map_within_rank_error(spark):
    n = 5000
    df = spark.range(n).select((F.col("id") % 1000).cast("double").alias("x"))
    row = Q.dense_map_approx(df, ["x"], rel_error=0.01).first()
    # true q95 over 0..999 repeated is about 950; the sketch is within 1% of rank
    assert abs(row["max"] - 950) <= 0.01 * 1000 + 1


def test_running_totals_many_slices_with_hot_group(spark):
    rows = [("hot", float(i), 1) for i in range(3000)] + [("cold", float(i), 2) for i in range(50)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    out = running_totals(df, ["g"], "v", ["w"], partitions=7).collect()
    for r in out:
        step = 1 if r.g == "hot" else 2
        assert r.cum_w == (int(r.v) + 1) * step
        assert r.tot_w == (3000 if r.g == "hot" else 100)


# --- balance / sampling ---------------------------------------------------------------------
def test_balance_empty_class_gives_empty(spark):
    df = spark.createDataFrame([(i, 0.0) for i in range(20)], "id long, label double")
    assert E.balance_to_ratio(df, (1, 1), key="id").count() == 0


def test_balance_already_at_ratio_keeps_all_and_drops_null_labels(spark):
    df = spark.createDataFrame([(i, float(i % 2)) for i in range(40)] + [(99, None)], "id long, label double")
    assert E.balance_to_ratio(df, (1, 1), key="id").count() == 40


def test_balance_to_minority_three_classes(spark):
    rows = [(i, "a") for i in range(300)] + [(1000 + i, "b") for i in range(100)] + [(2000 + i, "c") for i in range(600)]
    df = spark.createDataFrame(rows + [(9999, None)], "id long, cls string")
    got = {r.cls: r["count"] for r in E.balance_to_minority(df, "cls", key="id").groupBy("cls").count().collect()}
    assert got["b"] == 100 and None not in got
    assert 60 <= got["a"] <= 140 and 60 <= got["c"] <= 140


def test_sample_is_stable_under_repartitioning(spark):
    df = spark.range(2000).withColumnRenamed("id", "k")
    a = {r.k for r in E.sample_fraction(df, 0.3, key="k").collect()}
    b = {r.k for r in E.sample_fraction(df.repartition(7), 0.3, key="k").collect()}
    assert a == b and 450 <= len(a) <= 750


def test_split_is_disjoint_and_covers(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    s = E.with_split(df, (0.8, 0.2), key="k")
    parts = {r.split: r["count"] for r in s.groupBy("split").count().collect()}
    assert sum(parts.values()) == 3000 and set(parts) == {"train", "test"}
    assert 2250 <= parts["train"] <= 2550


# --- scoring --------------------------------------------------------------------------------
def test_auc_equals_pair_count_with_ties(spark):
    rng = np.random.default_rng(7)
    scores = np.round(rng.random(400), 2)
    labels = (rng.random(400) < 0.3).astype(float)
    df = spark.createDataFrame([(float(s), float(l)) for s, l in zip(scores, labels)], "predict double, label double")
    pos, neg = scores[labels == 1], scores[labels == 0]
    pairs = (pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()
    want = round(pairs / (len(pos) * len(neg)), 4)
    assert T.auc(df, partitions=5).first().auc == want


def test_confusion_strict_threshold_and_no_predicted_positive(spark):
    df = spark.createDataFrame([(0.5, 1.0), (0.5, 0.0), (1.0, 1.0), (0.0, 0.0)], "predict double, label double")
    rows = {r.threshold: r for r in T.threshold_confusion(df).collect()}
    r = rows[0.5]  # 0.5 is not > 0.5
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 0, 1, 2)
    last = rows[1.0]
    assert (last.tp, last.fp) == (0, 0) and last.precision is None
    for r in rows.values():
        assert r.tp + r.fp + r.fn + r.tn == 4


def test_penetration_is_monotone_and_uses_ge(spark):
    df = spark.createDataFrame([(1, 0.05), (1, 0.5), (2, 0.05), (None, 0.9)], "did int, predict double")
    rows = sorted(T.threshold_penetration(df, population=10).collect(), key=lambda r: r.threshold)
    assert rows[1].threshold == 0.05 and rows[1].n_rows == 4 and rows[1].n_entities == 3
    assert all(a.n_rows >= b.n_rows and a.n_entities >= b.n_entities for a, b in zip(rows, rows[1:]))


# --- vocabulary -----------------------------------------------------------------------------
def _merge_model(old, cands):
    """Independent list model of the documented refresh rule."""
    reserved = old[-1]
    cands = [c for c in cands if c != reserved]
    slots = old[:-1]
    kept = [v if v in cands else None for v in slots]
    rest = [c for c in cands if c not in slots]
    out = []
    for v, k in zip(slots, kept):
        if k is not None:
            out.append(k)
        elif rest:
            out.append(rest.pop(0))
        else:
            out.append(v)
    return out + [reserved]


@pytest.mark.parametrize(
    "old,cands",
    [
        (["a", "b", "c", "R"], ["c", "x", "R", "y", "z", "b"]),  # reserved among candidates, surplus
        (["a", "b", "c", "d", "R"], ["x"]),  # fewer candidates than gaps
        (["a", "b", "R"], ["a", "b"]),  # full overlap
        (["a", "b", "R"], ["x", "y"]),  # no overlap, equal count
        (["", "b", "R"], ["", "q"]),  # empty string is an ordinary value
    ],
)
def test_vocabulary_merge_matches_model(spark, old, cands):
    o = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(old)], "feature string, position long, value string")
    n = spark.createDataFrame([("f", v, 100 - i) for i, v in enumerate(cands)], "feature string, value string, cnt long")
    got = [r.value for r in sorted(V.vocabulary_merge(o, n).collect(), key=lambda r: r.position)]
    assert got == _merge_model(old, cands)
    assert len(got) == len(old) and got[-1] == old[-1]


# --- dates ----------------------------------------------------------------------------------
def test_dates_edges(spark):
    df = spark.createDataFrame([("20240228", "20240301"), ("20231231", "20231231"), ("20240105", "20240101")], "a string, b string")
    rows = df.select(day_sequence("a", "b").alias("days"), date_shift("a", -1).alias("back"), date_shift("a", 366).alias("fwd")).collect()
    assert rows[0].days == ["20240228", "20240229", "20240301"]
    assert rows[1].days == ["20231231"] and rows[1].fwd == "20241231"
    assert rows[2].days == [] and rows[2].back == "20240104"


# --- skew: one key holds a third of all rows ------------------------------------------------
def test_hot_session_and_hot_entity_against_brute_force(spark):
    import pandas as pd

    from keelson.operators import outcomes as O

    rng = np.random.default_rng(11)
    n = 3000
    sessions = np.where(rng.random(n) < 1 / 3, "HOT", np.array([f"s{i % 200}" for i in range(n)]))
    sessions = np.where(rng.random(n) < 0.05, None, sessions)
    values = rng.random(n) * 100
    codes = rng.choice([0, 401, 402], n, p=[0.2, 0.5, 0.3])
    pdf = pd.DataFrame({"session_id": sessions, "value": values, "error_code": codes})
    df = spark.createDataFrame(pdf).repartition(6)
    # anti join: sessions with any value < 0.5 go; null sessions stay
    bad = set(pdf.loc[pdf.value < 0.5, "session_id"].dropna())
    want = int((~pdf.session_id.isin(bad) | pdf.session_id.isna()).sum())
    assert S.drop_sessions_below(df, "value", 0.5).count() == want
    # per-code funnel with the hot entity and a null entity
    got = {r.error_code: (r.n_rows, r.n_entities, r.never_valid_entities) for r in O.outcome_funnel_by_code(df, "session_id").collect()}
    key = pdf.session_id.fillna("<null>")
    valid = set(key[pdf.error_code == 0])
    for c in (401, 402):
        ents = set(key[pdf.error_code == c])
        assert got[c] == (int((pdf.error_code == c).sum()), len(ents), len(ents - valid))


def test_topk_per_group_exact_with_hot_group(spark):
    from keelson.operators.ordered import top_k_per_group

    rows = [("hot", f"v{i:05d}", i % 97) for i in range(5000)] + [("cold", f"w{i}", i) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, value string, cnt long")
    got = top_k_per_group(df, ["g"], [F.col("cnt").desc(), F.col("value").asc()], 5, salts=16).collect()
    by = {}
    for r in got:
        by.setdefault(r.g, []).append((r._rank, r.value))
    want_hot = sorted(((-c, v) for _, v, c in rows if _ == "hot"))[:5]
    assert [v for _, v in sorted(by["hot"])] == [v for _, v in want_hot]
    assert len(by["cold"]) == 5


def test_distinct_entities_approx_is_close_and_counts_null(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 5000).alias("d"))
    exact = C.distinct_entities(df, "d").first().n_entities
    approx = C.distinct_entities(df, "d", approx=True).first().n_entities
    assert exact == 4501  # residues mod 5000 that are not multiples of 10, plus the null group
    assert abs(approx - exact) <= 0.05 * exact


def test_midpoint_many_slices_hot_value_against_numpy(spark):
    rng = np.random.default_rng(5)
    vals = np.round(rng.normal(10, 5, 5000), 1)
    vals[rng.random(5000) < 0.33] = 7.5  # one value holds a third of the rows
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    pcts = [float(p) for p in range(0, 101, 5)]
    got = {
        (r.variant, r.percentile): r.value
        for r in Q.percentiles_midpoint(df, ["x"], pcts, partitions=13).collect()
    }
    for variant, arr in (("all", vals), ("positive", vals[vals > 0])):
        want = np.percentile(arr, pcts, method="midpoint")
        for p, w in zip(pcts, want):
            assert got[(variant, p)] == pytest.approx(float(w), rel=0, abs=1e-12), (variant, p)


# --- selections -----------------------------------------------------------------------------
def test_selection_modes(spark):
    from keelson.operators import filters as B

    df = spark.createDataFrame([(True, "x"), (False, "y"), (None, "z")], "f boolean, c string")
    assert B.select_flagged(df, "mix", flag="f", name="f").count() == 3
    assert [r.c for r in B.select_flagged(df, "with_f", flag="f", name="f").collect()] == ["x"]
    assert [r.c for r in B.select_flagged(df, "without_f", flag="f", name="f").collect()] == ["y"]
    with pytest.raises(ValueError):
        B.select_flagged(df, "sometimes_f", flag="f", name="f")
    classes = {0: "x", 1: "y", 2: "z"}
    assert [r.c for r in B.select_user_class(df, 1, column="c", classes=classes).collect()] == ["y"]
    assert B.select_user_class(df, 7, column="c", classes=classes).count() == 3
    assert {r.c for r in B.unknown_class_values(df, column="c", classes={0: "x"}).collect()} == {"y", "z"}
    assert B.select_events(df.withColumnRenamed("c", "event_name"), ["x", "x", "z"]).count() == 2


def test_maps_with_only_missing_features_are_empty(spark):
    from keelson.operators.feature_map import feature_map, sparse_map

    df = spark.createDataFrame([(1.0, "a")], "x double, s string")
    assert Q.dense_map_exact(df, ["nope"]).count() == 0
    assert Q.dense_map_approx(df, ["nope"]).count() == 0
    assert sparse_map(df, ["nope"]).count() == 0
    assert feature_map(df, ["nope"], ["nada"], dense_method="exact").count() == 0
    with pytest.raises(ValueError):
        Q.dense_map_exact(df, ["nope"], ignore_missing=False)


def test_scoring_on_degenerate_inputs(spark):
    only_neg = spark.createDataFrame([(0.1, 0.0), (0.5, 0.0)], "predict double, label double")
    r = T.auc(only_neg).first()
    assert (r.auc, r.n_pos, r.n_neg) == (None, 0, 2)
    empty = spark.createDataFrame([], "predict double, label double")
    assert T.auc(empty).first().n_pos == 0
    rows = T.threshold_confusion(empty).collect()
    assert len(rows) == 21 and all(x.tp + x.fp + x.fn + x.tn == 0 and x.precision is None for x in rows)


def test_cap_paths_and_three_way_split(spark):
    df = spark.range(4000).withColumnRenamed("id", "k")
    assert E.sample_to_cap(df, 10_000, key="k").count() == 4000  # under the cap: unchanged
    assert E.sample_to_cap(df, 100, mode="none", key="k").count() == 4000  # not sampling
    known = E.sample_to_cap(df, 1000, n=4000, key="k").count()
    counted = E.sample_to_cap(df, 1000, key="k").count()
    assert known == counted and 850 <= known <= 1150  # same rows with a known or a counted total
    parts = {r.split: r["count"] for r in E.with_split(df, (0.6, 0.2, 0.2), ("a", "b", "c"), key="k").groupBy("split").count().collect()}
    assert set(parts) == {"a", "b", "c"} and sum(parts.values()) == 4000
    with pytest.raises(ValueError):
        E.with_split(df, (0.6, 0.2, 0.2), key="k")
