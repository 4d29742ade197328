"""Property checks: invariants that must hold for any input."""

import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SF_SMALL
from keelson.operators import counts as C
from keelson.operators import outcomes as O
from keelson.operators import sampling as E
from keelson.operators import thresholds as T
from keelson.operators import vocabulary as V
from keelson.plans.views import feed
from test_golden import _merge_model

VALUES = st.sampled_from([f"v{i}" for i in range(12)] + [""])


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    old=st.lists(VALUES, min_size=2, max_size=7, unique=True),
    cands=st.lists(VALUES, min_size=0, max_size=9, unique=True),
)
def test_vocabulary_merge_matches_model_and_keeps_shape(spark, old, cands):
    o = spark.createDataFrame([("f", i + 1, v) for i, v in enumerate(old)], "feature string, position long, value string")
    n = spark.createDataFrame(
        [("f", v, 100 - i) for i, v in enumerate(cands)] or [("g", "x", 1)], "feature string, value string, cnt long"
    )
    got = [r.value for r in sorted(V.vocabulary_merge(o, n).collect(), key=lambda r: r.position)]
    assert got == _merge_model(old, cands)
    assert len(got) == len(old) and got[-1] == old[-1]


def test_balance_hits_ratio_within_binomial_error(spark):
    f = feed(spark, SF_SMALL)
    for rate in ((1, 1), (2, 1), (5, 1)):
        out = E.balance_to_ratio(f, rate, key="event_id")
        c = {r.label: r["count"] for r in out.groupBy("label").count().collect()}
        src = {r.label: r["count"] for r in f.groupBy("label").count().collect()}
        assert c.get(0.0, 0) <= src[0.0] and c.get(1.0, 0) <= src[1.0]  # never adds rows
        want_neg = src[1.0] * rate[0] / rate[1]
        if want_neg < src[0.0]:
            # negatives were downsampled to about want_neg: allow 4 binomial standard deviations
            p = want_neg / src[0.0]
            sd = math.sqrt(src[0.0] * p * (1 - p))
            assert abs(c[0.0] - want_neg) <= 4 * sd + 1
            assert c[1.0] == src[1.0]


def test_reports_invariant_under_repartitioning(spark):
    f = feed(spark, SF_SMALL)
    g = f.repartition(7, "event_id")
    for fn in (
        lambda d: C.multi_value_counts(d, ["event_name", "label"]),
        lambda d: O.outcome_funnel_by_code(d, "session_id"),
        lambda d: T.threshold_confusion(d),
        lambda d: E.balance_to_ratio(d, (2, 1), key="event_id").select("event_id"),
    ):
        a, b = fn(f), fn(g)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_penetration_monotone_and_confusion_totals(spark):
    f = feed(spark, SF_SMALL)
    pen = sorted(T.threshold_penetration(f, "predict", "did").collect(), key=lambda r: r.threshold)
    assert all(a.n_rows >= b.n_rows and a.n_entities >= b.n_entities for a, b in zip(pen, pen[1:]))
    n = f.where(F.col("label").isin(0.0, 1.0)).count()
    assert all(r.tp + r.fp + r.fn + r.tn == n for r in T.threshold_confusion(f).collect())


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    vals=st.lists(st.sampled_from([-3.0, -0.5, 0.0, 0.25, 1.0, 1.5, 2.0, 7.0, 7.5, 100.0]), min_size=1, max_size=60),
    slices=st.integers(min_value=1, max_value=9),
)
def test_midpoint_percentiles_random_against_numpy(spark, vals, slices):
    import numpy as np

    from keelson.operators import quantiles as Q

    df = spark.createDataFrame([(v,) for v in vals], "x double")
    pcts = (0, 5, 25, 50, 75, 90, 95, 99, 100)
    got = {(r.variant, r.percentile): r.value for r in Q.percentiles_midpoint(df, ["x"], pcts, partitions=slices).collect()}
    for variant, arr in (("all", np.array(vals)), ("positive", np.array([v for v in vals if v > 0]))):
        if arr.size == 0:
            assert not any(k[0] == variant for k in got)
            continue
        for p, w in zip(pcts, np.percentile(arr, pcts, method="midpoint")):
            assert got[(variant, float(p))] == float(w), (variant, p, vals)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    vals=st.lists(st.one_of(st.none(), st.sampled_from(["a", "b", "c", "d", "e", "f"])), min_size=1, max_size=80),
    share=st.sampled_from([0.0, 0.05, 0.2]),
    max_len=st.integers(min_value=2, max_value=5),
)
def test_sparse_map_against_brute_force(spark, vals, share, max_len):
    from collections import Counter

    from keelson.operators.feature_map import sparse_map

    df = spark.createDataFrame([(v,) for v in vals], "s string")
    got = [(r.position, r.value, r.cnt) for r in sorted(sparse_map(df, ["s"], share, max_len).collect(), key=lambda r: r.position)]
    counts = Counter(vals)
    kept = [(v, c) for v, c in counts.items() if c / len(vals) >= share]
    kept.sort(key=lambda vc: (-vc[1], vc[0] is None, vc[0] or ""))
    want = [(i + 1, v, c) for i, (v, c) in enumerate(kept)] if 2 <= len(kept) <= max_len else []
    assert got == want


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    rows=st.lists(
        st.tuples(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]), st.sampled_from([0.0, 1.0])),
        min_size=2,
        max_size=80,
    ),
    slices=st.integers(min_value=1, max_value=7),
)
def test_auc_random_against_pair_count(spark, rows, slices):
    pos = [s for s, y in rows if y == 1.0]
    neg = [s for s, y in rows if y == 0.0]
    df = spark.createDataFrame(rows, "predict double, label double")
    got = T.auc(df, partitions=slices).first()
    if not pos or not neg:
        assert got.auc is None
        return
    pairs = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    # Spark rounds the decimal form half-up, Python's round() the binary value: compare to 4 places.
    assert abs(got.auc - pairs / (len(pos) * len(neg))) <= 0.00005 + 1e-12
    assert (got.n_pos, got.n_neg) == (len(pos), len(neg))


def test_shuffle_places_rows_without_sampling_them(spark):
    from keelson.functions.sampling import unit_hash
    from keelson.operators.sampling import SHUFFLE_SEED, shuffle_rows

    df = spark.range(500).withColumn("v", F.col("id") % 7)
    got = shuffle_rows(df, key="id", partitions=5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and got.rdd.getNumPartitions() == 5
    u = [r.u for r in got.select(unit_hash(F.col("id").cast("string"), SHUFFLE_SEED).alias("u")).collect()]
    assert u == sorted(u) and len(u) == 500
    assert [r.id for r in shuffle_rows(df.repartition(7), key="id", partitions=3).collect()] == [r.id for r in got.collect()]
    twice = shuffle_rows(df.select("v"), partitions=4)
    assert sorted(r.v for r in twice.collect()) == sorted(i % 7 for i in range(500))


def test_sketches_of_days_add_up(spark):
    from keelson.operators import sketches as S

    rows = [(f"2024010{1 + i % 3}", "ab"[i % 2], i % 4000 if i % 11 else None) for i in range(9000)]
    df = spark.createDataFrame(rows, "dt string, g string, did long")
    stored = S.daily_sketches(df, "did", by=["g"])
    assert {r.dt for r in stored.collect()} == {"20240101", "20240102", "20240103"}
    for start, end in ((None, None), ("20240102", "20240103"), ("20240103", "20240103")):
        inside = [r for r in rows if (start or "") <= r[0] <= (end or "9")]
        exact = len({r[2] for r in inside})
        got = S.entities_over(stored, start, end).first()
        assert got.n_rows == len(inside) and abs(got.n_entities - exact) <= S.error_bound() * exact
        for r in S.penetration_over(stored, ["g"], start, end).collect():
            part = len({x[2] for x in inside if x[1] == r.g})
            assert abs(r.share - part / exact) < 2 * S.error_bound()
    assert S.entities_over(stored, "2030").first().n_entities == 0
    assert S.entities_over(S.daily_sketches(df.limit(0), "did")).first().n_rows == 0


def test_first_split_of_the_tree_is_the_best_gain(spark):
    from keelson.operators.importance import feature_importance, split_gains
    from keelson.operators.sampling import with_split

    rows = [(i, float(i % 13), float(i * 7 % 10), 3.0, float((i % 13 > 8) != (i % 10 == 0))) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, label double")
    train = with_split(df, key="id").where("split = 'train'")
    got = {r.feature: r for r in split_gains(train, ["a", "b", "c"], partitions=3).collect()}
    kept = [(r.a, r.b, r.label) for r in train.collect()]

    def gini(part):
        p = sum(x[2] for x in part) / len(part)
        return 2 * p * (1 - p)

    for k, f in ((0, "a"), (1, "b")):
        best = None
        for t in sorted({x[k] for x in kept})[:-1]:
            left, right = [x for x in kept if x[k] <= t], [x for x in kept if x[k] > t]
            gain = gini(kept) - (len(left) * gini(left) + len(right) * gini(right)) / len(kept)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, t, len(left))
        assert abs(got[f].gain - best[0]) < 1e-12 and (got[f].threshold, got[f].n_left) == best[1:]
    assert set(got) == {"a", "b"}
    tree = {r.name: r.value for r in feature_importance(df, ["a", "b", "c"], key="id", max_depth=1).collect() if r.section == "importance"}
    assert max(got, key=lambda f: got[f].gain) == max(tree, key=tree.get) == "a" and tree["a"] == 1.0
