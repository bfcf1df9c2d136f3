"""The paths large tables take, forced on small ones and compared with brute force."""

import datetime
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tabscout.operators import ordering as O
from tabscout.operators import series as S
from tabscout.operators import split as SP
from tabscout.operators import training as T
from tabscout.operators.evaluate import roc_auc
from tabscout.operators.explore import duplicate_rows
from tabscout.operators.quantiles import exact_quantiles, order_statistics
from tabscout.operators.series import lag_features, prepare_time_frame, typical_step


def skewed_values(n=4000, seed=1):
    """A third of all rows share one value."""
    rng = random.Random(seed)
    return [7.5 if rng.random() < 0.34 else round(rng.expovariate(0.1), 3) for _ in range(n)]


def test_order_statistics_by_narrowing(spark):
    values = skewed_values()
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
    ranks = [0, 1, 999, 1360, 1361, 2000, 3998, 3999]
    found = order_statistics(df, {"v": ranks}, settle_rows=3)["v"]
    ordered = sorted(values)
    assert found == {r: ordered[r] for r in ranks}


def test_exact_quantiles_match_numpy_on_both_paths(spark):
    values = skewed_values(seed=5)
    df = spark.createDataFrame([(v, int(v * 10)) for v in values], "a double, b bigint")
    shares = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]
    for limit in (10, 10**6):
        found = exact_quantiles(df, ["a", "b"], shares, small_rows=limit)
        assert np.allclose(found["a"], np.quantile(values, shares))
        assert np.allclose(found["b"], np.quantile([int(v * 10) for v in values], shares))


def test_quantiles_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(1.0, None)] * 30, "a double, b double")
    found = exact_quantiles(df, ["a", "b"], [0.5], small_rows=5)
    assert found["a"] == [1.0]
    assert found["b"] == [None]


def hot_series(spark, n=1500):
    """A third of all rows share one moment; the key breaks the tie."""
    rng = random.Random(3)
    base = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        at = base + datetime.timedelta(minutes=500 if rng.random() < 0.34 else rng.randrange(1000))
        rows.append((i, at, float(rng.randrange(100)) if rng.random() > 0.05 else None, rng.choice(["x", "y", "z'\\"])))
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "id int, at timestamp, v double, s string").repartition(4)


def plan_size(df):
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def brute_lags(rows, series):
    out = {}
    groups = {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        groups.setdefault(r[3] if series else None, []).append(r)
    for members in groups.values():
        for i, r in enumerate(members):
            before = [m[2] for m in members[max(0, i - 5):i]]
            lags = [members[i - k][2] if i >= k else None for k in (1, 2, 3)]
            mean = sum(before) / 5 if len(before) == 5 and None not in before else None
            out[r[0]] = (*lags, mean)
    return out


def same_history(got, want):
    for r in got:
        expected = want[r["id"]]
        assert (r["v_lag1"], r["v_lag2"], r["v_lag3"]) == expected[:3]
        assert (r["v_avg5"] is None) == (expected[3] is None)
        assert expected[3] is None or abs(r["v_avg5"] - expected[3]) < 1e-9


def test_history_features_across_bucket_edges(spark):
    rows, df = hot_series(spark)
    for series in (None, "s"):
        for size in (7, 100, 10**6):
            frame, names, dropped = prepare_time_frame(df, "at", "v", ["id"], series, per_bucket=size)
            got = frame.collect()
            assert len(got) == len(rows) and dropped == 0
            assert names == ["v_lag1", "v_lag2", "v_lag3", "v_avg5"]
            same_history(got, brute_lags(rows, series))


def test_hot_moment_is_spread_over_buckets(spark):
    rows, df = hot_series(spark)
    keyed, _, bounds = O.with_buckets(df, O.order_terms(df, "at", ["id"]), len(rows), per_bucket=100)
    sizes = [r["count"] for r in keyed.groupBy("_bucket").count().collect()]
    assert bounds > 10 and max(sizes) < 250


def test_buckets_are_not_capped(spark, monkeypatch):
    """Thousands of buckets, some of them shorter than the reach, with edges that go to buckets again."""
    rows, df = hot_series(spark, 6000)
    keyed, _, bounds = O.with_buckets(df, O.order_terms(df, "at", ["id"]), len(rows), per_bucket=5)
    assert bounds > 900 and keyed.agg(F.countDistinct("_bucket")).first()[0] > 900
    monkeypatch.setattr(O, "SAMPLE", 3000)
    for series in (None, "s"):
        frame, _, _ = prepare_time_frame(df, "at", "v", ["id"], series, per_bucket=40)
        same_history(frame.collect(), brute_lags(rows, series))


def test_buckets_of_odd_values_in_a_plan_of_one_size(spark):
    """Buckets follow Spark's order of nulls, NaN, zeros and texts, and the plan doesn't grow with the bounds."""
    rng = random.Random(5)
    numbers, words = [None, math.nan, math.inf, -math.inf, -0.0, 0.0, 1.5, 2.5], [None, "", "a", "B", "ä", "\U0001f600", "\uffee"]
    rows = [(rng.choice(numbers), rng.choice(words), None if i % 9 == 0 else 2**53 + i % 700) for i in range(3000)]
    df = spark.createDataFrame(rows, "x double, w string, k bigint")
    terms = [F.col("x"), F.col("w"), F.col("k")]
    plans = []
    for size in (3, 40, 1500):
        keyed, order, bounds = O.with_buckets(df, terms, len(rows), per_bucket=size)
        plans.append(plan_size(keyed))
        got = [r["_bucket"] for r in keyed.coalesce(1).sortWithinPartitions(*order).collect()]
        assert got == sorted(got) and max(got) <= bounds
        assert len(set(got)) > bounds * 0.9
        by_value = keyed.groupBy(*terms).agg(F.countDistinct("_bucket").alias("n")).agg(F.max("n")).first()[0]
        assert by_value == 1
    assert max(plans) < 1.2 * min(plans)


def test_typical_step_with_hot_moments(spark):
    """The median of all gaps, zero ones between equal moments included, for one series and for each of many."""
    base = 1_700_000_000
    moments = {"a": [0, 1, 4, 5, 8, 9], "b": [0] * 50 + [7, 9], "c": [3], "d": [0, 2, 6, 12, 20], None: [1, 4]}
    rows = [(k, base + 86400 * m) for k, ms in moments.items() for m in ms]
    df = spark.createDataFrame(rows, "k string, at long").withColumn("at", F.timestamp_seconds("at"))

    def median(ms):
        gaps = [b - a for a, b in zip(sorted(ms), sorted(ms)[1:])]
        middle = int(np.median(gaps) * 86_400_000_000) if gaps else 0
        return middle if middle > 0 else 86_400_000_000

    got = {r["k"]: r["step_micros"] for r in S.median_gap(S.date_gaps(df, "at", ["k"], 3), ["k"]).collect()}
    assert got == {k: median(ms) for k, ms in moments.items() if len(ms) > 1}
    for k, ms in moments.items():
        one = df.filter(F.col("k").eqNullSafe(F.lit(k)))
        assert S.typical_step(one, "at", 4).first()["step_micros"] == median(ms)


def test_text_lags(spark):
    rows, df = hot_series(spark, 300)
    got = {r["id"]: r["s_lag1"] for r in lag_features(df, "at", "s", ["id"], per_bucket=20).collect()}
    ordered = sorted(rows, key=lambda r: (r[1], r[0]))
    assert all(got[b[0]] == a[3] for a, b in zip(ordered, ordered[1:]))


def test_text_lags_of_many_series_have_a_small_plan(spark):
    rows, df = hot_series(spark, 1200)
    few, out = (lag_features(df, "at", "s", ["id"], series="s", per_bucket=size) for size in (600, 10))
    assert plan_size(out) < 1.2 * plan_size(few)
    got, last = {r["id"]: r["s_lag1"] for r in out.collect()}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        assert got[r[0]] == last.get(r[3])
        last[r[3]] = r[3]


def test_global_position(spark):
    rows, df = hot_series(spark)
    placed = O.global_position(df, O.order_terms(df, "at", ["id"]), per_bucket=50)
    got = {r["id"]: r["position"] for r in placed.collect()}
    assert got == {r[0]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}


def test_cut_points_with_ties(spark):
    rows, df = hot_series(spark)
    terms = O.order_terms(df, "at", ["id"])
    ordered = [r[0] for r in sorted(rows, key=lambda r: (r[1], r[0]))]
    ranks = [0, 1, 400, 600, 700, 1499, 1500]
    points = O.cut_points(df, terms, ranks, len(rows))
    for rank in ranks:
        got = {r["id"] for r in df.filter(O.before_rank(terms, points, rank, len(rows))).collect()}
        assert got == set(ordered[:rank])


def test_time_split_sizes(spark):
    rows, df = hot_series(spark)
    sizes = {r["part"]: r["count"] for r in SP.time_split(df, "at", ["id"], gap=13).groupBy("part").count().collect()}
    assert sizes == {"train": 1187, "gap": 13, "test": 300}


def test_hash_split_sizes_with_a_dominant_class(spark):
    df = spark.range(30_000).withColumn("c", F.when(F.col("id") % 50 == 0, "rare").otherwise("usual"))
    out = SP.random_split(df, ["id"], stratify="c").groupBy("c", "is_test").count().collect()
    got = {(r["c"], r["is_test"]): r["count"] for r in out}
    assert got == {("rare", True): 120, ("rare", False): 480, ("usual", True): 5880, ("usual", False): 23520}


def test_folds_are_even_and_flags_disjoint(spark):
    df = spark.range(1003).withColumn("c", (F.col("id") % 3).cast("string"))
    folds = {r["fold"]: r["count"] for r in SP.kfold_column(df, ["id"]).groupBy("fold").count().collect()}
    assert sorted(folds) == [0, 1, 2, 3, 4] and max(folds.values()) - min(folds.values()) <= 1
    flags = SP.training_flags(df, ["id"], "c", 1003)
    row = flags.agg(F.count_if("_test").alias("t"), F.count_if("_watch").alias("w"),
                    F.count_if(F.col("_test") & F.col("_watch")).alias("both")).first()
    assert 201 <= row["t"] <= 203 and 79 <= row["w"] <= 84 and row["both"] == 0


def test_cap_rows(spark):
    df = spark.range(500).withColumn("at", F.timestamp_seconds(F.col("id") % 100))
    assert SP.cap_rows(df, 123, ["id"]).count() == 123
    kept = SP.cap_rows(df, 7, ["id"], time="at").collect()
    assert sorted(r["id"] for r in kept) == sorted(sorted(range(500), key=lambda i: (i % 100, i))[-7:])


def test_auc_by_buckets_matches_pairs(spark):
    rng = random.Random(2)
    rows = [(round(rng.random(), 2), "y" if rng.random() < 0.4 else "n") for _ in range(600)]
    df = spark.createDataFrame(rows, "p double, a string")
    pos = [p for p, a in rows if a == "y"]
    neg = [p for p, a in rows if a == "n"]
    wins = sum((x > y) + 0.5 * (x == y) for x in pos for y in neg) / (len(pos) * len(neg))
    assert abs(roc_auc(df, "a", "p", "y", per_bucket=10).first()["roc_auc"] - wins) < 1e-12


def test_duplicates_with_nulls_and_swapped_columns(spark):
    rows = [(1, None), (None, 1), (1, None), (2, 2), (2, 2), (2, 2), (None, None), (None, None)]
    df = spark.createDataFrame(rows, "a int, b int")
    assert duplicate_rows(df).first()["duplicate_rows"] == 4


def test_typical_step_falls_back_to_a_day(spark):
    one = spark.createDataFrame([(datetime.datetime(2024, 1, 1),)], "at timestamp")
    assert typical_step(one, "at").first()["step_micros"] == 86_400_000_000


def test_auc_of_many_buckets_has_a_small_plan(spark):
    rng = random.Random(8)
    rows = [(rng.random() if i % 5 else 0.5, rng.choice("ab")) for i in range(2500)]
    df = spark.createDataFrame(rows, "p double, y string")
    few, out = (roc_auc(df, "y", "p", "a", per_bucket=size) for size in (1000, 2))
    assert plan_size(out) < 1.2 * plan_size(few)
    hits, others = ([p for p, y in rows if y == v] for v in "ab")
    wins = sum((h > o) + (h == o) / 2 for h in hits for o in others)
    assert abs(out.first()[0] - wins / (len(hits) * len(others))) < 1e-9


def test_a_run_reads_its_source_a_few_times_and_leaves_nothing_cached(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = 4000
    df = spark.range(rows, numPartitions=1).selectExpr("id", "id % 37 * 1.5D as a", "id % 11 + id % 37 * 2D as y").mapInArrow(counted, "id bigint, a double, y double")
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    T.train(df, "y", ["id"], exclude=("id",), params=T.Params(n_estimators=2), cross_validation=False, with_linear=False, with_band=False)
    assert seen.value <= 3 * rows
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= cached
