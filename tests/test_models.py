"""Training, evaluation, explanation, forecast, targets and runs on planted effects."""

import datetime
import itertools
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabscout.errors import TabularError
from tabscout.functions.scalars import hash_key
from tabscout.operators import evaluate as E
from tabscout.operators import explain as X
from tabscout.operators import forecast as FC
from tabscout.operators import runs as R
from tabscout.operators import targets as TG
from tabscout.operators import training as T
from tabscout.operators import trees as TR
from tabscout.operators.series import append_future, future_dates
from tabscout.operators.trees import Forest, Tree, shapley_table
from tabscout.plans.catalog import QUERIES

QUICK = T.Params(n_estimators=25, max_depth=3, learning_rate=0.3, max_bins=32)
LIGHT = dict(params=QUICK, cross_validation=False, with_linear=False)


def frame(spark, n=800):
    h = hash_key("id")
    return spark.range(n).select(
        "id", ((h % 1000) / 50.0).alias("signal"), ((F.floor(h / 1000) % 1000) / 10.0).alias("noise"),
        F.element_at(F.array(F.lit("red"), F.lit("green"), F.lit("blue")), (F.floor(h / 7) % 3 + 1).cast("int")).alias("color"),
    ).withColumn("signal", F.when(F.col("id") % 9 != 0, F.col("signal")))


@pytest.fixture(scope="module")
def rows(spark):
    value = 3 * F.coalesce("signal", F.lit(10.0)) + F.col("noise") / 50 + F.when(F.col("color") == "red", 5).otherwise(0)
    df = frame(spark).withColumn("y", value).withColumn("won", F.when(value > 33, "yes").otherwise("no"))
    return df.withColumn("band", F.when(value < 20, "low").when(value < 45, "mid").otherwise("high")).cache()


@pytest.fixture(scope="module")
def number(rows):
    return T.train(rows.drop("won", "band"), "y", ["id"], exclude=("id",), params=QUICK)


@pytest.fixture(scope="module")
def binary(rows):
    return T.train(rows.drop("y", "band"), "won", ["id"], exclude=("id",), **LIGHT)


@pytest.fixture(scope="module")
def bands(rows):
    return T.train(rows.drop("y", "won"), "band", ["id"], exclude=("id",), **LIGHT)


def test_regression_run(number, spark):
    m = number.metrics
    assert m["r2"] > 0.8 and m["mae"] < m["baseline_mae"] and m["cv_folds"] == 5 and m["cv_std"] < 0.2
    assert m["test_rows"] == 160 and number.rows_used == 800
    assert number.importance[0][0] == "signal" and abs(sum(s for _, s in number.importance) - 1) < 0.001
    assert number.validation.columns[-2:] == ["predicted", "error"] and number.validation.count() == 160
    worst = number.validation.agg(F.max(F.abs(F.col("error") - (F.col("predicted") - F.col("y"))))).first()[0]
    assert worst < 1e-4


def test_band_is_ordered_and_covers(number, rows):
    out = number.model.score(rows).agg(F.bool_and(F.col("low") <= F.col("high")).alias("o"),
                                       F.avg(F.col("y").between(F.col("low"), F.col("high")).cast("double")).alias("c")).first()
    assert out["o"] and 0.65 < out["c"] < 0.97


def test_binary_and_multiclass_runs(binary, bands):
    assert binary.metrics["accuracy"] > 0.85 and binary.metrics["roc_auc"] > 0.9
    assert bands.metrics["accuracy"] > 0.7 and bands.metrics["roc_auc"] is None and len(bands.model.spec.classes) == 3


def shap_gap(model, df, raw):
    out = X.shap_values(model, model.score(df)).withColumn("t", F.aggregate("contributions", F.col("bias"), lambda a, b: a + b))
    return out.agg(F.max(F.abs(F.col("t") - raw))).first()[0]


def test_shap_adds_up(number, binary, bands, rows):
    p = F.element_at("probability", 2)
    assert shap_gap(number.model, rows, F.col("prediction")) < 1e-6
    assert shap_gap(binary.model, rows, F.ln(p / (1 - p))) < 1e-6
    out = X.shap_values(bands.model, bands.model.margins(rows)).withColumn("t", F.aggregate("contributions", F.col("bias"), lambda a, b: a + b))
    assert out.agg(F.max(F.abs(F.col("t") - F.element_at("margins", F.col("explained_class") + 1)))).first()[0] < 1e-6


def toy_tree():
    #      0: x0 <= 1 ? 1 : 2 ; 1: x1 <= 0 ? 3 : 4 ; 2: x0 <= 3 ? 5 : 6
    return Tree(np.array([0, 1, 0, -1, -1, -1, -1]), np.array([1.0, 0, 3, 0, 0, 0, 0]), np.array([1, 3, 5, -1, -1, -1, -1]),
                np.array([2, 4, 6, -1, -1, -1, -1]), np.array([10.0, 6, 4, 1, 5, 3, 1]),
                np.array([[0.0], [0], [0], [2], [-1], [4], [9]]))


def expected(tree, x, known, node=0):
    if tree.left[node] < 0:
        return tree.value[node, 0]
    f, left, right = tree.feature[node], tree.left[node], tree.right[node]
    if f in known:
        return expected(tree, x, known, left if x[f] <= tree.threshold[node] else right)
    w = tree.cover[left] / tree.cover[node]
    return w * expected(tree, x, known, left) + (1 - w) * expected(tree, x, known, right)


def test_shap_equals_brute_force():
    tree = toy_tree()
    forest = Forest([tree], [1.0], 2)
    x = np.array([[0.0, -1.0], [0.0, 1.0], [2.0, 0.0], [5.0, 2.0]])
    got = forest.shap(x, 0)
    for i, row in enumerate(x):
        for f in (0, 1):
            rest = [g for g in (0, 1) if g != f]
            total = 0.0
            for size in range(len(rest) + 1):
                for known in itertools.combinations(rest, size):
                    w = math.factorial(size) * math.factorial(2 - size - 1) / 2
                    total += w * (expected(tree, row, {*known, f}) - expected(tree, row, set(known)))
            assert abs(got[i, f] - total) < 1e-12
    assert abs(forest.bias()[0] - expected(tree, x[0], set())) < 1e-12
    assert np.allclose(shapley_table(np.array([[1.0]]), np.array([0.25])), [[0.75]])


@pytest.mark.parametrize("room", [TR.KNOWN_BYTES, 200, 0])
def test_equal_cells_are_worked_out_once(monkeypatch, room):
    """Rows between the same thresholds share one score and one explanation, in all batches, equal to their own bit by bit."""
    monkeypatch.setattr(TR, "KNOWN_BYTES", room)
    sets = Tree(np.array([1, -1, -1]), np.zeros(3), np.array([1, -1, -1]), np.array([2, -1, -1]), np.array([9.0, 4, 5]), np.array([[0.0], [0.3], [-0.7]]),
                {0: np.array([0.0, 2.0])}, np.array([True, False, False]))
    forest, rng, worked = Forest([toy_tree(), sets, toy_tree()], [1.0, 0.5, 0.1], 2), np.random.default_rng(3), []
    plain, shap = Forest.predict, Forest.shap
    monkeypatch.setattr(Forest, "predict", lambda self, x: (worked.append(len(x)), plain(self, x))[1])
    monkeypatch.setattr(Forest, "shap", lambda self, x, output: (worked.append(len(x)), shap(self, x, output))[1])
    for _ in range(3):
        x = np.column_stack([rng.normal(2, 3, 2000), rng.integers(-1, 4, 2000)])
        x[rng.random((2000, 2)) < 0.1] = np.nan
        x[:4, 0] = [1.0, 3.0, math.inf, -math.inf]
        assert np.array_equal(forest.known_margins(x), plain(forest, x))
        assert np.array_equal(forest.known_shap(x, np.zeros(2000, dtype=int)), shap(forest, x, 0))
    cells = 4 * 6  # three ranges and missing; values -1 to 3 and missing
    assert max(worked) <= cells and (not room or room == 200 or sum(worked) <= 2 * cells)


def test_too_many_possible_cells_are_scored_one_by_one(monkeypatch):
    slots = 12
    trees = [Tree(np.array([k, -1, -1]), np.array([float(t), 0, 0]), np.array([1, -1, -1]), np.array([2, -1, -1]), np.array([2.0, 1, 1]),
                  np.array([[0.0], [1.0 * k], [0.01 * t]])) for k in range(slots) for t in range(63)]
    forest, x = Forest(trees, [1.0] * len(trees), slots), np.random.default_rng(5).random((50, slots)) * 63
    assert forest.cells(x) is None
    assert np.array_equal(forest.known_margins(x), forest.predict(x)) and np.array_equal(forest.known_shap(x, np.zeros(50, dtype=int)), forest.shap(x, 0))


def test_scores_are_those_of_the_trees(binary, bands, number, rows):
    from pyspark.ml.functions import vector_to_array

    for result in (binary, bands, number):
        model = result.model
        out = model.score_vectors(model.vectors(rows, [])).select(vector_to_array("features").alias("x"), "*").limit(300).collect()
        x = np.array([r["x"] for r in out])
        raw = model.forest.predict(x)
        if result is number:
            assert np.allclose(raw[:, 0], [r["_prediction"] for r in out])
        elif result is binary:
            assert np.allclose(1 / (1 + np.exp(-raw[:, 0])), [r["_probability"][1] for r in out])
        else:
            assert np.allclose(np.exp(raw) / np.exp(raw).sum(axis=1, keepdims=True), [r["_probability"] for r in out])


def test_explanations(number, bands, rows):
    item = X.explain(bands.model, rows.limit(5)).collect()[0]
    sizes = [abs(i["contribution"]) for i in item["items"]]
    assert sizes == sorted(sizes, reverse=True) and item["toward_label"] in bands.model.spec.classes
    impact = X.impact_summary(number.model, rows).orderBy("rank").collect()
    assert impact[0]["feature"] == "signal" and impact[0]["axis_high"] == "pushes y higher"
    points = X.impact_points(number.model, rows, ["signal"], ["id"])
    assert points.count() == 800 and points.filter("value_label = 'missing' and value_norm is not null").count() == 0
    matrix = X.insights_matrix(number.model, rows)
    assert matrix.filter("a = 'signal' and b = 'Predicted y'").first()["value"] > 0.9


def test_surrogate(number, rows):
    s = X.surrogate_tree(number.model, rows)
    nodes = {r["node"]: r for r in s.nodes.collect()}
    assert s.fidelity > 0.7 and len(nodes) <= 15 and nodes[0]["samples"] == 800 and "signal" in nodes[0]["question"]
    leaves = [r for r in nodes.values() if r["leaf_label"]]
    assert sum(r["samples"] for r in leaves) == 800 and min(r["samples"] for r in leaves) >= 40


def test_sensitivity_and_monotone_rule(spark, rows, number):
    result = T.train(rows.drop("won", "band"), "y", ["id"], exclude=("id",), with_band=False,
                     overrides=T.Overrides(monotone={"noise": -1, "signal": 1}, max_depth=4), **LIGHT)
    scenarios = spark.createDataFrame([(1, "red"), (2, None)], "sid int, color string")
    for feature, rising in (("signal", True), ("noise", False)):
        curve = X.sensitivity(result.model, scenarios, feature, "sid").orderBy("sid", "point").collect()
        assert len(curve) == 42
        for sid in (1, 2):
            v = [r["output"] for r in curve if r["sid"] == sid]
            assert all((a <= b) if rising else (a >= b) for a, b in zip(v, v[1:]))
    colors = X.sensitivity(number.model, scenarios, "color", "sid").collect()
    assert len(colors) == 6 and {r["value"] for r in colors} == {"red", "green", "blue"}
    with pytest.raises(TabularError):
        X.sensitivity(number.model, scenarios, "nope", "sid")


def test_monotone_trees_keep_the_level_and_add_up(spark):
    """On a wave the rule can't be met exactly, but predictions must not be lifted; contributions follow the rule too."""
    h = hash_key("id")
    wave = spark.range(4000).select("id", ((h % 1000) / 20.0).alias("x"), ((F.floor(h / 1000) % 1000) / 100.0).alias("z"))
    wave = wave.withColumn("y", 10 * F.sin(F.col("x") / 5) + F.col("z"))
    result = T.train(wave, "y", ["id"], exclude=("id",), overrides=T.Overrides(monotone={"x": 1, "z": 1}),
                     params=T.Params(n_estimators=40, max_depth=4, learning_rate=0.2, max_bins=32), cross_validation=False, with_linear=False)
    scored = result.model.score(wave)
    real, guessed = scored.agg(F.avg("y"), F.avg("prediction")).first()
    assert abs(guessed - real) < 0.05 * abs(real)
    out = X.shap_values(result.model, scored).select((F.aggregate("contributions", F.col("bias"), lambda a, b: a + b) - F.col("prediction")).alias("gap"))
    assert out.agg(F.max(F.abs("gap"))).first()[0] < 1e-6
    curve = [r["output"] for r in X.sensitivity(result.model, wave.limit(1).select("id", "z"), "x", "id").orderBy("point").collect()]
    assert all(a <= b for a, b in zip(curve, curve[1:]))


def test_many_classes_and_rare_ones(spark):
    """More classes than learners guess, and one that no training row may hold."""
    h = hash_key("id")
    many = spark.range(3000).select("id", (h % 1000).cast("double").alias("x"), F.concat(F.lit("c"), (h % 120).cast("string")).alias("k"))
    result = T.train(many, "k", ["id"], exclude=("id",), params=T.Params(n_estimators=2, max_depth=3, max_bins=32), cross_validation=False, with_linear=False)
    assert len(result.model.spec.classes) == 120
    assert result.scored.select(F.size("probability")).distinct().collect()[0][0] == 120
    for only in (3, 7, 11):  # one of them is a test row, or none: either way the run holds
        rare = spark.range(400).select("id", (h % 100).cast("double").alias("x"), F.when(F.col("id") == only, "once").when(h % 100 < 50, "a").otherwise("b").alias("k"))
        result = T.train(rare, "k", ["id"], exclude=("id",), **LIGHT)
        sizes = result.model.score(rare).select(F.size("probability").alias("n")).distinct().collect()
        assert [r["n"] for r in sizes] == [3]
        assert X.shap_values(result.model, rare, class_index=2).count() == 400
    with pytest.raises(TabularError) as err:
        T.train(spark.range(3000).select("id", (h % 1000).cast("double").alias("x"), F.concat(F.lit("c"), (F.col("id") / 2).cast("int").cast("string")).alias("k")),
                "k", ["id"], task="classification", exclude=("id",), **LIGHT)
    assert err.value.code == "TOO_MANY_CLASSES"


def test_save_and_load(spark, number, rows, tmp_path):
    T.save_model(number.model, str(tmp_path / "m"))
    again = T.load_model(spark, str(tmp_path / "m"))
    a = number.model.score(rows).select("id", "prediction", "low", "high").orderBy("id").collect()
    b = again.score(rows).select("id", "prediction", "low", "high").orderBy("id").collect()
    assert a == b and again.spec == number.model.spec


def test_a_run_hashes_its_keys_once(rows, binary, monkeypatch):
    """Splits and blocks take the hash that is kept with the rows, and give the same run."""
    monkeypatch.setattr(T.SP, "hash_key", None)
    again = T.train(rows.drop("y", "band"), "won", ["id"], exclude=("id",), **LIGHT)
    assert again.metrics == binary.metrics and again.losses == binary.losses


def test_leakage_and_simple_warnings(spark, rows):
    leaky = rows.drop("y", "band").withColumn("leak", F.concat(F.lit("x"), "won"))
    result = T.train(leaky, "won", ["id"], exclude=("id",), params=QUICK, cross_validation=False)
    codes = {c: col for c, col, _ in result.warnings}
    assert codes["POSSIBLE_LEAKAGE"] == "leak" and "SIMPLE_RELATIONSHIPS" in codes


def test_imbalance(spark, rows):
    rare = rows.drop("y", "band", "won").withColumn("rare", F.when((F.col("signal") > 19), "y").otherwise("n"))
    result = T.train(rare, "rare", ["id"], exclude=("id",), **LIGHT)
    assert "CLASS_IMBALANCE" in [c for c, _, _ in result.warnings]


def test_thorough_respects_pins(rows):
    result = T.train(rows.drop("y", "band"), "won", ["id"], exclude=("id",), effort="thorough", trials=2,
                     overrides=T.Overrides(max_depth=2), params=T.Params(n_estimators=2), cross_validation=False, with_linear=False)
    assert len(result.trials) == 2 and all(p.max_depth == 2 for p, _ in result.trials)
    assert result.trials[0][1] <= result.trials[1][1] and result.metrics["tuning_trials"] == 2


@pytest.mark.parametrize("change, code", [
    (dict(target="id"), "UNSUPPORTED_TARGET"), (dict(target="zz"), "UNKNOWN_COLUMN"), (dict(exclude=("zz",)), "UNKNOWN_COLUMN"),
    (dict(exclude=("y",)), "TARGET_EXCLUDED"), (dict(horizon=3), "INVALID_HORIZON"), (dict(time="signal"), "INVALID_TIME_COLUMN"),
    (dict(overrides=T.Overrides(monotone={"color": 1})), "INVALID_MONOTONE_COLUMN"), (dict(effort="huge"), "INVALID_EFFORT"),
])
def test_argument_errors(rows, change, code):
    settings = {"target": "y", "key": ["id"], **LIGHT, **change}
    with pytest.raises(TabularError) as err:
        T.train(rows.drop("won", "band"), **settings)
    assert err.value.code == code


def test_too_few_rows_and_bad_knobs(rows):
    with pytest.raises(TabularError) as err:
        T.train(rows.drop("won", "band").filter("id < 40"), "y", ["id"], **LIGHT)
    assert err.value.code == "TOO_FEW_ROWS"
    for bad in (dict(max_depth=1), dict(learning_rate=0.9), dict(monotone={"x": 2}), dict(reg_lambda=11.0)):
        with pytest.raises(TabularError):
            T.Overrides(**bad)


@pytest.fixture(scope="module")
def daily(spark):
    h = hash_key("id")
    return spark.range(400).select(
        F.date_add(F.lit("2022-01-01").cast("date"), F.col("id").cast("int")).alias("day"), "id",
        (100 + F.when(F.col("id") % 7 < 2, 30).otherwise(0) + (h % 50) / 10.0).cast("double").alias("sales"))


def test_time_model_and_forecast(spark, daily):
    result = T.train(daily, "sales", ["id"], time="day", horizon=3, exclude=("id",), params=T.Params(n_estimators=30, max_depth=4, learning_rate=0.2))
    assert result.metrics["test_rows"] == 80 and result.metrics["cv_folds"] == 5
    assert {"sales_lag1", "sales_avg5"} <= set(result.model.spec.names)
    first_test = result.validation.agg(F.min("id")).first()[0]
    assert first_test == 320
    points = FC.forecast(result.model, daily, "day", 14, ["id"]).orderBy("step").collect()
    assert [p["step"] for p in points] == list(range(1, 15)) and points[0]["date"] == "2023-02-05"
    assert all(p["low"] <= p["high"] for p in points)
    # 2022-01-01 opened a cycle of two high days and five low ones; day 400 is its second day.
    high = [p["predicted"] for p in points if (399 + p["step"]) % 7 < 2]
    low = [p["predicted"] for p in points if (399 + p["step"]) % 7 >= 2]
    assert min(high) > 120 and max(low) < 112
    with pytest.raises(TabularError):
        FC.forecast(result.model, daily, "day", 366, ["id"])
    with pytest.raises(TabularError) as err:
        T.train(daily, "sales", ["id"], time="day", horizon=310, exclude=("id",), **LIGHT)
    assert err.value.code == "HORIZON_TOO_LARGE"


def test_first_forecast_step_is_the_plain_score(spark, daily):
    """Step one must equal scoring a hand-made next row."""
    result = T.train(daily, "sales", ["id"], time="day", exclude=("id",), with_band=False, **LIGHT)
    known = [r["sales"] for r in daily.orderBy("id").collect()]
    row = spark.createDataFrame(
        [(datetime.date(2023, 2, 5), 0.0, known[-1], known[-2], known[-3], sum(known[-5:]) / 5)],
        "day date, sales double, sales_lag1 double, sales_lag2 double, sales_lag3 double, sales_avg5 double")
    want = result.model.score(row).first()["prediction"]
    got = FC.forecast(result.model, daily, "day", 1, ["id"]).first()["predicted"]
    assert abs(got - want) < 1e-4


def test_forecast_needs_numbers(binary, rows):
    with pytest.raises(TabularError):
        FC.forecast(binary.model, rows, "id", 3, ["id"])


def test_chart_rows(spark, daily):
    history = daily.filter("id < 3").withColumn("predicted", F.when(F.col("id") != 1, F.col("sales") + 1))
    future = spark.createDataFrame([("2022-01-04", 9.0, 8.0, None)], "date string, predicted double, low double, high double")
    out = append_future(history, future, "day", "sales").orderBy("date").collect()
    assert [(r["actual"] is not None, r["forecast"] is not None) for r in out] == [(True, False), (True, True), (False, True)]
    assert out[2]["low"] is None
    assert [r["date"] for r in future_dates(daily, "day", 2).collect()] == ["2023-02-05", "2023-02-06"]


def test_thresholds_and_calibration(spark):
    df = spark.range(1000).select(((F.col("id") + 0.5) / 1000).alias("p"), F.when(F.col("id") % 1000 < F.col("id"), "y").otherwise("n").alias("a"))
    df = df.withColumn("a", F.when(hash_key("p") % 1000 < F.col("p") * 1000, "y").otherwise("n"))
    curve = E.threshold_curve(df, "a", "p", "y").orderBy("threshold").collect()
    assert len(curve) == 21 and all(a["recall"] >= b["recall"] for a, b in zip(curve, curve[1:]))
    assert curve[20]["precision"] is None and curve[0]["flagged_pct"] == 100.0
    points = E.calibration(df, "a", "p", "y")
    assert points.agg(F.sum("count")).first()[0] == 1000
    assert E.calibration_error(points).first()["verdict"] == "well calibrated"
    assert E.threshold_at(E.threshold_curve(df, "a", "p", "y"), 0.525).first()["threshold"] == 0.5


def test_group_check(spark):
    df = spark.range(400).select(
        F.when(F.col("id") % 4 == 0, "south").otherwise("north").alias("region"), F.lit("a").alias("actual"),
        F.when((F.col("id") % 4 == 0) & (F.col("id") % 10 < 4), "b").otherwise("a").alias("guess"))
    found = E.group_check(df, "classification", "actual", "guess", ["region"]).collect()
    assert [(r["value"], r["rows"]) for r in found] == [("south", 100)]
    assert E.group_check(df, "classification", "actual", "guess", []).count() == 0


def test_target_analysis_finds_the_planted_target(spark):
    df = frame(spark, 600).select(
        "id", F.coalesce("signal", F.lit(3.0)).alias("driver"), "color", F.element_at(F.array(F.lit("p"), F.lit("q")), (hash_key("id", "color") % 2 + 1).cast("int")).alias("coin"))
    # Two drivers of like weight and one row in ten the other way: with one clean driver the outcome would
    # rightly be called its duplicate.
    over = F.col("driver") + F.when(F.col("color") == "red", 12).otherwise(0) > 14
    df = df.withColumn("outcome", F.when(over != (hash_key("color", "id") % 10 == 0), "yes").otherwise("no"))
    found = TG.analyze(df, ["id"])
    rows = {r["column"]: r for r in found.candidates.collect()}
    assert "id" not in rows and rows["outcome"]["recommended"] and rows["coin"]["signal"] < 0.15
    assert rows["outcome"]["signal"] > 0.5 and rows["outcome"]["top_predictors"][0][0] == "driver"
    rating = found.rating.first()
    assert rating["rating"] in ("great", "good") and rating["best_target"] == "outcome"


def test_copies_are_called_out(spark):
    df = frame(spark, 500).select("id", "color", F.concat(F.lit("c-"), "color").alias("copy"), "noise")
    rows = {r["column"]: r for r in TG.analyze(df, ["id"]).candidates.collect()}
    assert rows["color"]["caution"] == "DUPLICATE" and not rows["color"]["recommended"]


def test_feature_ideas(spark):
    h = hash_key("id")
    df = spark.range(1500).select("id", (5 + h % 95).cast("double").alias("distance"), (1 + F.floor(h / 100) % 40).cast("double").alias("duration"),
                                  (F.floor(h / 9999) % 50).cast("double").alias("other"))
    df = df.withColumn("speed", F.col("distance") / F.col("duration")).drop("id")
    spec = TG.build_feature_spec(df, "speed")
    ideas = TG.feature_ideas(df, spec, [("distance", 0.5), ("duration", 0.4), ("other", 0.1)]).collect()
    assert ideas[0]["name"] == "distance_per_duration" and ideas[0]["share"] > 0.3


def test_runs(spark, tmp_path, rows):
    path = str(tmp_path / "runs")
    early, late = (datetime.datetime(2024, 1, d, tzinfo=datetime.timezone.utc) for d in (1, 2))
    for args in (
        dict(status="complete", metrics={"r2": 0.4}, run_id="a", created_at=early), dict(status="queued", run_id="b", created_at=early),
        dict(status="complete", metrics={"r2": 0.6}, run_id="c", created_at=early, label="  Best  "), dict(status="failed", run_id="d", created_at=late),
        dict(status="complete", metrics={"r2": 0.6}, run_id="e", created_at=late),
    ):
        R.record_run(spark, path, R.run_row("ds", "y", "regression", **args))
    runs = R.list_runs(spark, path, "ds")
    ranked = [r["run_id"] for r in R.rank_runs(runs).orderBy("position").collect()]
    assert ranked == ["b", "e", "c", "a", "d"]
    assert R.rank_runs(runs).filter("run_id = 'c'").first()["shown_label"] == "Best"
    assert R.best_run(runs).first()["run_id"] == "c" and R.best_run(runs.filter("run_id = 'a'")).count() == 0
    assert R.list_runs(spark, path, "other").count() == 0
    for bad in (dict(status="done"), dict(status="queued", label="x" * 81), dict(status="queued", horizon=10_001)):
        with pytest.raises(TabularError):
            R.run_row("ds", "y", "regression", **bad)


def test_the_simple_variant_is_shallow_with_a_heavier_penalty(rows):
    """As in the reference: depth 3 and lambda 5, and nothing else."""
    light = dict(exclude=("id",), trials=1, cross_validation=False, with_linear=False, with_band=False)
    runs = {r["label"]: r for r in R.compare_variants(rows.drop("won", "band"), "ds", "y", ["id"], T.Params(n_estimators=3), **light).collect()}
    assert [(runs[v]["status"], runs[v]["overrides"]) for v in ("Standard", "Thorough")] == [("complete", None)] * 2
    assert T.Overrides(**json.loads(runs["Simple"]["overrides"])) == T.Overrides(max_depth=3, reg_lambda=5.0)
    same = T.train(rows.drop("won", "band"), "y", ["id"], params=T.Params(n_estimators=3, max_depth=3, reg_lambda=5.0), **light)
    assert math.isclose(runs["Simple"]["metrics"]["mae"], same.metrics["mae"], rel_tol=1e-9)


def test_suggestions(spark):
    shape = "run_id string, feature string, source string, share double, is_dataset_column boolean"
    table = spark.createDataFrame([
        ("r", "a", "a", 0.6, True), ("r", "b", "b", 0.395, True), ("r", "d_year", "d", 0.004, True), ("r", "d_month", "d", 0.001, True),
        ("r", "y_lag1", "y_lag1", 0.0, False), ("s", "a", "a", 1.0, True), ("s", "b", "b", 0.0, True),
    ], shape)
    assert [(r["run_id"], r["source"]) for r in R.suggest_exclusions(table).collect()] == [("r", "d")]
    assert R.retrain_exclusions(["x"], None, ["d", "x"]) == ["x", "d"] and R.retrain_exclusions(["x"], "leak", ["d"]) == ["x", "leak"]


def test_report(spark, number, rows):
    report = R.model_report(spark, number, X.impact_summary(number.model, rows), overrides=T.Overrides(max_depth=3))
    sections = {r["section"] for r in report.collect()}
    assert sections == {"about", "metrics", "validation", "importance", "settings", "impacts"} | ({"warnings"} if number.warnings else set())


def test_feature_vector_fills_gaps_with_the_median(spark, tmp_path):
    """Every 7th order lacks its quantity: the vector holds the median of the others and tells the gap."""
    rows = [(k, 1, k, k, float(k * 37 % 101), 0.01 * (k * 29 % 53), 0.0, "AN"[k % 2], "OF"[k % 2]) for k in range(1, 141)]
    names = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(rows, names).write.parquet(str(tmp_path / "lineitem.parquet"))
    found = QUERIES["feature_vector"](spark, str(tmp_path)).collect()
    middle = float(np.median([r[4] for r in rows if r[0] % 7]))
    assert {r.l_orderkey: (r.gap, r.quantity, round(r.discount, 9)) for r in found} == {
        r[0]: (not r[0] % 7, r[4] if r[0] % 7 else middle, round(r[5], 9)) for r in rows}
