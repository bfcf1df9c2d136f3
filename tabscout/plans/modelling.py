"""Checked queries: training, scoring, explanation, forecast, targets and runs.

Model outputs have no SQL form, so these queries either return rows for a weaker check or
state an invariant over every row (additivity, monotony, order of a band) that SQL states
too. Models are trained once per session and data folder and shared by the queries.
"""

from __future__ import annotations

import datetime

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout.functions.scalars import hash_key
from tabscout.operators import boosting as B
from tabscout.operators import evaluate as E
from tabscout.operators import explain as X
from tabscout.operators import forecast as FC
from tabscout.operators import runs as R
from tabscout.operators import split as SP
from tabscout.operators import targets as TG
from tabscout.operators import training as T
from tabscout.operators import trees as TR
from tabscout.operators.features import apply_feature_spec, build_feature_spec
from tabscout.operators.profile import column_facts, column_profiles
from tabscout.plans import fixtures as fx
from tabscout.plans.registry import query, table

# The shared models learn in larger steps than the default, up to its 500 rounds and with its patience; train_full is the default itself.
FAST = T.Params(learning_rate=0.3, max_depth=4)
KEYS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
_trained: dict[tuple, T.TrainingResult] = {}


def _number_rows(spark, d) -> DataFrame:
    return fx.planted_lineitem(spark, d).drop("band")


def _band_rows(spark, d) -> DataFrame:
    return fx.planted_lineitem(spark, d).drop("y")


def _class_rows(spark, d) -> DataFrame:
    return fx.planted_orders(spark, d).drop("o_custkey")


def _daily(spark, d) -> DataFrame:
    return table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(
        F.sum("o_totalprice").alias("total"), F.max("o_orderpriority").alias("latest"))


def trained(spark: SparkSession, d: str, kind: str) -> T.TrainingResult:
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _trained:
        quick = dict(params=FAST, cross_validation=False, with_linear=False)
        if kind == "number":
            made = T.train(_number_rows(spark, d), "y", list(fx.LINE_KEY), exclude=KEYS, **quick)
        elif kind == "bands":
            made = T.train(_band_rows(spark, d), "band", list(fx.LINE_KEY), exclude=KEYS, **quick)
        elif kind == "class":
            made = T.train(_class_rows(spark, d), "won", ["o_orderkey"], exclude=("o_orderkey",), **quick)
        elif kind == "rising":
            made = T.train(_number_rows(spark, d), "y", list(fx.LINE_KEY), exclude=KEYS, with_band=False,
                           overrides=T.Overrides(monotone={"l_quantity": 1}), **quick)
        else:
            made = T.train(_daily(spark, d), "total", ["day"], time="day", horizon=2, **quick)
        _trained[key] = made
    return _trained[key]


def _count(df: DataFrame, **flags) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in flags.items()])


# ------------------------------------------------------------------ training

HELD = "(select sum(floor((n * 200 + 999) / 1000)) from (select count(*) as n from {} group by {}))"


@query("train_number", f"""select {HELD.format('lineitem', '1::int').replace('group by 1::int', '')}::bigint as test_rows, true as learns,
  true as beats_mean""")
def train_number(spark, d):
    m = trained(spark, d, "number").metrics
    return spark.createDataFrame([(m["test_rows"], m["r2"] > 0.7, m["mae"] < 0.5 * m["baseline_mae"])],
                                 "test_rows bigint, learns boolean, beats_mean boolean")


@query("train_class", f"select {HELD.format(fx.PLANTED_ORDERS, 'won')}::bigint as test_rows, true as learns, true as beats_majority")
def train_class(spark, d):
    m = trained(spark, d, "class").metrics
    return spark.createDataFrame([(m["test_rows"], m["accuracy"] > 0.85 and m["roc_auc"] > 0.9, m["accuracy"] > m["baseline_accuracy"])],
                                 "test_rows bigint, learns boolean, beats_majority boolean")


@query("train_bands", f"select {HELD.format(fx.PLANTED_LINEITEM, 'band')}::bigint as test_rows, true as learns, 3 as classes")
def train_bands(spark, d):
    r = trained(spark, d, "bands")
    return spark.createDataFrame([(r.metrics["test_rows"], r.metrics["accuracy"] > 0.7, len(r.model.spec.classes))],
                                 "test_rows bigint, learns boolean, classes int")


@query("train_over_time", """select n - n * 800 // 1000 as test_rows, 'total_avg5,total_lag1,total_lag2,total_lag3' as history from
  (select count(distinct o_orderdate::date) as n from orders)""")
def train_over_time(spark, d):
    r = trained(spark, d, "time")
    made = sorted(n for n in r.model.spec.names if n.startswith("total_"))
    return spark.createDataFrame([(r.metrics["test_rows"], ",".join(made))], "test_rows bigint, history string")


@query("train_full", f"""select {HELD.format('lineitem', '1::int').replace('group by 1::int', '')}::bigint as test_rows, true as kept_least_loss,
  true as patient, 5 as folds, true as learns, true as folds_agree, true as banded, true as has_linear""")
def train_full(spark, d):
    """A run with all defaults: up to 500 rounds of depth 6 with patience, five folds, linear baseline and band."""
    r = T.train(_number_rows(spark, d), "y", list(fx.LINE_KEY), exclude=KEYS)
    m = r.metrics
    inside = r.scored.agg(F.avg(F.col("y").between(F.col("low"), F.col("high")).cast("double"))).first()[0]
    row = (m["test_rows"], r.losses[r.rounds - 1] == min(r.losses), len(r.losses) in (r.rounds + B.PATIENCE, r.params.n_estimators), m["cv_folds"],
           m["r2"] > 0.7, abs(m["cv_mean"] - m["r2"]) < 0.05, 0.75 < inside < 0.9, "linear_r2" in m)
    return spark.createDataFrame([row], "test_rows bigint, kept_least_loss boolean, patient boolean, folds int, learns boolean, folds_agree boolean, "
                                        "banded boolean, has_linear boolean")


@query("training_metrics")
def training_metrics(spark, d):
    return trained(spark, d, "class").metrics_table(spark)


@query("training_warnings")
def training_warnings(spark, d):
    return trained(spark, d, "time").warnings_table(spark)


@query("feature_vector", f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity is null as gap,
  coalesce(l_quantity, (select median(l_quantity) from {fx.PLANTED_LINEITEM})) as quantity, l_discount as discount from {fx.PLANTED_LINEITEM}""")
def feature_vector(spark, d):
    """The vectors of both encoders: gaps filled with the median and told by a slot of their own, and values as they are."""
    df = _number_rows(spark, d)
    profiles = column_facts(df)
    spec = build_feature_spec(df, "y", profiles=profiles, user_excluded=KEYS)
    encoder, filler = T.Encoder(spec), T.filled_encoder(spec, profiles)
    out = encoder.encode(apply_feature_spec(df, spec, [F.col(k) for k in fx.LINE_KEY]))
    out = filler.encode(out, "filled")
    x, filled = vector_to_array("features"), vector_to_array("filled")
    gap = next((i for i, s in enumerate(filler.slots) if (s.feature, s.kind) == ("l_quantity", "missing")), None)  # no slot without gaps
    return out.select(*fx.LINE_KEY, (F.lit(False) if gap is None else filled[gap] == 1).alias("gap"),
                      filled[filler.slot_of("l_quantity")].alias("quantity"), x[encoder.slot_of("l_discount")].alias("discount"))


def _encoded(spark, d, kind: str):
    rows, target, key = (_number_rows, "y", list(fx.LINE_KEY)) if kind == "number" else (_class_rows, "won", ["o_orderkey"])
    df = rows(spark, d)
    r = trained(spark, d, kind)
    flagged = SP.training_flags(df, key, target if kind == "class" else None, df.count())
    keep = [T.label_alias(r.model.spec, T.label_column(r.model.spec, flagged)), hash_key(*key).alias("_key"), F.col("_test"), F.col("_watch"), F.col("_fold")]
    return r, r.model.encoder.encode(apply_feature_spec(flagged, r.model.spec, keep)).repartition(
        spark.sparkContext.defaultParallelism, "_key").persist()


def _ground(spark, d, kind: str, max_bins: int = 64):
    """The rows of a run, packed, with their roles."""
    r, encoded = _encoded(spark, d, kind)
    learn, watch = ~F.col("_test"), F.col("_watch")
    roles = {"learn": learn, "fit": learn & ~watch, "watch": watch}
    roles |= {f"{side}{i}": (F.col("_fold") != i if side == "in" else F.col("_fold") == i) for i in range(5) for side in ("in", "out")}
    return r, encoded, T.pack_rows(encoded, r.model.spec, r.model.encoder, roles, max_bins, key=F.col("_key"))


WATCHED = """(select sum(floor(((n - t) * 100 + 999) / 1000)) from (select n, floor((n * 200 + 999) / 1000) as t from
  (select count(*) as n from {} group by {})))"""


@query("fit_with_early_stopping", f"""select {WATCHED.format(fx.PLANTED_ORDERS, 'won')}::bigint as watched_rows, true as kept_least_loss,
  true as patient, true as learns""")
def fit_with_early_stopping(spark, d):
    """One model whose loss on the watched rows ends it."""
    r, encoded, ground = _ground(spark, d, "class")
    fit = T.fit_model(ground, FAST, "fit", "watch")
    scored = T.quality(T.TrainedModel(r.model.spec, r.model.encoder, ground.forest(fit)), encoded.filter("_test"), r.model.spec)
    least = min(fit.losses)
    watched = encoded.filter("_watch").count()
    row = (watched, fit.losses[len(fit.rounds) - 1] == least, len(fit.losses) in (len(fit.rounds) + B.PATIENCE, FAST.n_estimators), scored > 0.9)
    ground.close()
    encoded.unpersist()
    return spark.createDataFrame([row], "watched_rows bigint, kept_least_loss boolean, patient boolean, learns boolean")


@query("tune", f"""select {WATCHED.format(fx.PLANTED_ORDERS, 'won')}::bigint as watched_rows, rank::int as rank, true as in_range, true as not_better,
  true as finite from range(12) t(rank)""")
def tune(spark, d):
    """Twelve trials over all knobs, best first, with 50 rounds at most."""
    r, encoded, ground = _ground(spark, d, "class")
    found = T.tune(ground, T.Params(n_estimators=50), {}, "fit", "watch")
    watched = encoded.filter("_watch").count()
    ground.close()
    encoded.unpersist()
    ranges = lambda p: 3 <= p.max_depth <= 8 and 0.01 <= p.learning_rate <= 0.2 and 0.6 <= min(p.subsample, p.colsample)
    rows = [(watched, i, ranges(p) and p.min_child in (1, 2, 4, 8), loss >= found[max(i - 1, 0)][1], 0 < loss < 1) for i, (p, loss) in enumerate(found)]
    return spark.createDataFrame(rows, "watched_rows bigint, rank int, in_range boolean, not_better boolean, finite boolean")


@query("linear_baseline", "select true as good_linear_fit")
def linear_baseline(spark, d):
    r, encoded = _encoded(spark, d, "number")
    m = T.linear_baseline(encoded.filter("not _test"), encoded.filter("_test"), r.model.spec, r.model.encoder)
    encoded.unpersist()
    return spark.createDataFrame([(0.8 < m["linear_r2"] < 0.95,)], "good_linear_fit boolean")


@query("linear_baseline_class", "select true as good_linear_fit")
def linear_baseline_class(spark, d):
    r, encoded = _encoded(spark, d, "class")
    m = T.linear_baseline(encoded.filter("not _test"), encoded.filter("_test"), r.model.spec, r.model.encoder)
    encoded.unpersist()
    return spark.createDataFrame([(m["linear_accuracy"] > 0.85,)], "good_linear_fit boolean")


@query("cross_validate", "select 5 as folds, count(*)::bigint as tested, true as steady from lineitem")
def cross_validate(spark, d):
    """Five models that grow in the same passes, each tested on its own fold."""
    r, encoded, ground = _ground(spark, d, "number")
    m = T.cross_validate(ground, T.Params(learning_rate=0.3, max_depth=4, n_estimators=50), [(f"in{i}", f"out{i}") for i in range(5)])
    tested = encoded.filter(F.col("_fold").between(0, 4)).count()
    ground.close()
    encoded.unpersist()
    low, high = E.consistency_range(F.lit(m["cv_mean"]), F.lit(m["cv_std"]))
    return spark.range(1).select(F.lit(m["cv_folds"]).alias("folds"), F.lit(tested).alias("tested"), ((low > 0.6) & (high - low < 0.1)).alias("steady"))


@query("rank_importance", "select 'l_quantity' as top, true as sums_to_one")
def rank_importance(spark, d):
    t = trained(spark, d, "number").importance_table(spark)
    return t.agg(F.max_by("feature", "share").alias("top"), (F.abs(F.sum("share") - 1) < 0.001).alias("sums_to_one"))


@query("score_number", "select count(*) as rows, true as filled from lineitem")
def score_number(spark, d):
    return _count(trained(spark, d, "number").model.score(_number_rows(spark, d)), filled=F.bool_and(F.col("prediction").isNotNull()))


@query("score_class", "select count(*) as rows, true as sums_to_one, true as agrees from orders")
def score_class(spark, d):
    model = trained(spark, d, "class").model
    out = model.class_columns(model.score(_class_rows(spark, d)))
    agrees = (F.col("prediction") == "yes") == (F.col("probability_yes") > 0.5)
    return _count(out, sums_to_one=F.bool_and(F.abs(F.col("probability_yes") + F.col("probability_no") - 1) < 1e-9), agrees=F.bool_and(agrees))


@query("prediction_band", "select count(*) as rows, true as ordered, true as near_80 from lineitem")
def prediction_band(spark, d):
    out = trained(spark, d, "number").model.score(_number_rows(spark, d))
    inside = F.avg(F.col("y").between(F.col("low"), F.col("high")).cast("double"))
    return _count(out, ordered=F.bool_and(F.col("low") <= F.col("high")), near_80=(inside >= 0.72) & (inside <= 0.93))


@query("monotone_score", """select count(*) as curves, true as never_falls from (select distinct l_discount, l_tax, l_returnflag,
  l_linestatus from lineitem)""")
def monotone_score(spark, d):
    model = trained(spark, d, "rising").model
    parts = ["l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    scenarios = _number_rows(spark, d).select(*parts).distinct().withColumn("scenario", F.concat_ws("|", *parts))
    curve = X.sensitivity(model, scenarios, "l_quantity", "scenario")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("point", "output"))), lambda s: s["output"])
    each = curve.groupBy("scenario").agg(ordered.alias("o"))  # 21 points per curve
    rising = F.forall(F.sequence(F.lit(2), F.size("o")), lambda i: F.element_at("o", i) >= F.element_at("o", i - 1))
    return each.agg(F.count(F.lit(1)).alias("curves"), F.bool_and(rising).alias("never_falls"))


@query("save_and_load_model", "select count(*) as rows, true as same from lineitem")
def save_and_load_model(spark, d):
    model = trained(spark, d, "number").model
    path = TR.scratch_path(spark, "io")
    T.save_model(model, path)
    both = model.score(_number_rows(spark, d)).withColumnsRenamed({"prediction": "p1", "low": "l1", "high": "h1"})
    again = T.load_model(spark, path).score(both)
    same = (F.col("p1") == F.col("prediction")) & (F.abs(F.col("l1") - F.col("low")) < 1e-9) & (F.abs(F.col("h1") - F.col("high")) < 1e-9)
    return _count(again, same=F.bool_and(same))


@query("validation_rows", f"select {HELD.format(fx.PLANTED_ORDERS, 'won')}::bigint as rows, true as consistent")
def validation_rows(spark, d):
    v = trained(spark, d, "class").validation
    return _count(v, consistent=F.bool_and((F.col("correct") == (F.col("won") == F.col("predicted"))) & F.col("confidence").between(0.5, 1)))


# ------------------------------------------------------------------ explanation


@query("shap_values")
def shap_values(spark, d):
    model = trained(spark, d, "class").model
    out = X.shap_values(model, _class_rows(spark, d))
    return X.contributions_long(model, out, ["o_orderkey"])


def _gap(raw):
    total = F.aggregate("contributions", F.col("bias"), lambda a, b: a + b)
    return F.bool_and(F.abs(total - raw) < 1e-6)


@query("shap_additive_number", "select count(*) as rows, true as additive from lineitem")
def shap_additive_number(spark, d):
    model = trained(spark, d, "number").model
    out = X.shap_values(model, model.score(_number_rows(spark, d)))
    return _count(out, additive=_gap(F.col("prediction")))


@query("shap_additive_rising", "select count(*) as rows, true as additive from lineitem")
def shap_additive_rising(spark, d):
    model = trained(spark, d, "rising").model
    out = X.shap_values(model, model.score(_number_rows(spark, d)))
    return _count(out, additive=_gap(F.col("prediction")))


@query("shap_additive_class", "select count(*) as rows, true as additive from orders")
def shap_additive_class(spark, d):
    model = trained(spark, d, "class").model
    out = X.shap_values(model, model.score(_class_rows(spark, d)))
    p = F.element_at("probability", 2)
    return _count(out, additive=_gap(F.ln(p / (1 - p))))


@query("shap_additive_bands", "select count(*) as rows, true as additive from lineitem")
def shap_additive_bands(spark, d):
    model = trained(spark, d, "bands").model
    out = X.shap_values(model, model.margins(_band_rows(spark, d)))
    return _count(out, additive=_gap(F.element_at("margins", F.col("explained_class") + 1)))


@query("explain")
def explain(spark, d):
    out = X.explain(trained(spark, d, "bands").model, _band_rows(spark, d))
    return out.select(*fx.LINE_KEY, F.col("items")[0]["feature"].alias("first_feature"), F.col("items")[0]["contribution"].alias("first_contribution"),
                      "baseline", "toward_label")


@query("impact_summary", "select 'l_quantity' as first_feature, true as falling, true as used_only")
def impact_summary(spark, d):
    out = X.impact_summary(trained(spark, d, "number").model, _number_rows(spark, d))
    return out.agg(F.min_by("feature", "rank").alias("first_feature"), (F.corr("rank", "mean_abs_contribution") < 0).alias("falling"),
                   F.bool_and(F.col("mean_abs_contribution") > 0).alias("used_only"))


@query("impact_points", f"""with t as (select * from {fx.PLANTED_ORDERS}), b as (select min(o_totalprice) as low, max(o_totalprice) as high from t)
  select o_orderkey, 'o_totalprice' as feature, round((o_totalprice - low) / (high - low), 4) as value_norm,
    coalesce(o_totalprice::varchar, 'missing') as value_label, true as counted from t, b
  union all select o_orderkey, 'o_orderpriority', null, coalesce(o_orderpriority, 'missing'), true from t""")
def impact_points(spark, d):
    points = X.impact_points(trained(spark, d, "class").model, _class_rows(spark, d), ["o_totalprice", "o_orderpriority"], ["o_orderkey"])
    return points.select("o_orderkey", "feature", "value_norm", "value_label", F.col("contribution").isNotNull().alias("counted"))


CLASSES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query("class_focus", """select (row_number() over (order by p) - 1)::int as class_index, p as label from (select o_orderpriority as p, count(*) as n
  from orders group by 1) qualify n = max(n) over ()""")
def class_focus(spark, d):
    return X.class_focus(table(spark, d, "orders").withColumnRenamed("o_orderpriority", "prediction"), CLASSES)


@query("insights_matrix")
def insights_matrix(spark, d):
    return X.insights_matrix(trained(spark, d, "class").model, _class_rows(spark, d))


@query("sensitivity", "select count(distinct c_custkey) * 21 as rows, true as between_0_and_1 from customer")
def sensitivity(spark, d):
    scenarios = table(spark, d, "customer").select(
        F.col("c_custkey").alias("scenario"), F.when(F.col("c_nationkey") % 2 == 0, "1-URGENT").otherwise("5-LOW").alias("o_orderpriority"))
    out = X.sensitivity(trained(spark, d, "class").model, scenarios, "o_totalprice", "scenario")
    return _count(out, between_0_and_1=F.bool_and(F.col("output").between(0, 1)))


@query("sensitivity_category")
def sensitivity_category(spark, d):
    scenarios = table(spark, d, "customer").select(F.col("c_custkey").alias("scenario"), (F.abs("c_acctbal") / 250).alias("l_quantity"))
    return X.sensitivity(trained(spark, d, "bands").model, scenarios, "l_returnflag", "scenario")


@query("surrogate_tree", "select count(*) as rows, true as faithful, true as shallow from lineitem")
def surrogate_tree(spark, d):
    s = X.surrogate_tree(trained(spark, d, "number").model, _number_rows(spark, d))
    return s.nodes.agg(F.max("samples").alias("rows"), F.lit(s.fidelity > 0.8).alias("faithful"), (F.count(F.lit(1)) <= 15).alias("shallow"))


@query("surrogate_nodes")
def surrogate_nodes(spark, d):
    return X.surrogate_tree(trained(spark, d, "bands").model, _band_rows(spark, d)).nodes


@query("tree_nodes", "select true as adds_up, true as sides_differ, true as gains")
def tree_nodes(spark, d):
    """The covers of two sides add up to their node's, and every split gains."""
    nodes = TR.forest_table(spark, trained(spark, d, "class").model.forest)
    sides = [nodes.select("tree", F.col("node").alias(s), F.col("cover").alias(f"c_{s}")) for s in ("left", "right")]
    both = nodes.filter("left >= 0").join(sides[0], ["tree", "left"]).join(sides[1], ["tree", "right"])
    return both.agg(F.bool_and(F.abs(F.col("c_left") + F.col("c_right") - F.col("cover")) < 1e-6 * F.col("cover")).alias("adds_up"),
                    F.bool_and(F.col("left") != F.col("right")).alias("sides_differ"), F.bool_and(F.col("gain") > 0).alias("gains"))


# ------------------------------------------------------------------ forecast


@query("forecast", """select k as step, strftime(((select max(o_orderdate) from orders) + to_days(k::int))::date, '%Y-%m-%d') as date,
  true as banded from (select unnest(range(1, 31)) as k)""")
def forecast(spark, d):
    out = FC.forecast(trained(spark, d, "time").model, _daily(spark, d), "day", 30, ["day"])
    return out.select("step", "date", ((F.col("low") <= F.col("high")) & F.col("predicted").isNotNull()).alias("banded"))


@query("forecast_per_series", "select user_id, count(*) as events, 7 as steps from events group by 1 having count(*) > 0")
def forecast_per_series(spark, d):
    df = table(spark, d, "events").select("event_id", "ts", "user_id", "value")
    key = (spark.sparkContext.applicationId, d, "series")
    if key not in _trained:
        _trained[key] = T.train(df, "value", ["event_id"], time="ts", series="user_id", exclude=("event_id",), params=FAST,
                                cross_validation=False, with_linear=False)
    out = FC.forecast(_trained[key].model, df, "ts", 7, ["event_id"], series="user_id")
    counts = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    return counts.join(out.groupBy("user_id").agg(F.count("predicted").cast("int").alias("steps")), "user_id")


# ------------------------------------------------------------------ targets

# Each customer stands for a candidate column of its nation's data set.
H = fx.hash_sql("c_custkey")
CANDIDATES = f"""(select c_nationkey as dataset, c_custkey::int as position, c_name as "column",
  case when h % 7 = 0 then 'id_like' when h % 7 < 4 then 'numeric' else 'categorical' end as kind,
  (h % 60)::double as missing_pct, h % 29 as unique_count, 100 + h % 1500 as row_count,
  (h % 101) / 100.0::double as balance, case when h % 7 < 4 then 'regression' else 'classification' end as task,
  case when h % 11 = 0 then 0.995::double else (h % 1000) / 1000.0::double end as probe_score, 0.4::double as baseline,
  case when h % 11 = 0 then 0.98::double else (h % 997) / 997.0::double end as signal, (h % 103) / 102.0::double as top_share
  from (select *, {H} as h from customer))"""


def candidates(spark, d):
    h = F.col("h")
    return table(spark, d, "customer").withColumn("h", hash_key("c_custkey")).select(
        F.col("c_nationkey").alias("dataset"), F.col("c_custkey").cast("int").alias("position"), F.col("c_name").alias("column"),
        F.when(h % 7 == 0, "id_like").when(h % 7 < 4, "numeric").otherwise("categorical").alias("kind"),
        (h % 60).cast("double").alias("missing_pct"), (h % 29).alias("unique_count"), (100 + h % 1500).alias("row_count"),
        ((h % 101) / 100.0).alias("balance"), F.when(h % 7 < 4, "regression").otherwise("classification").alias("task"),
        F.when(h % 11 == 0, 0.995).otherwise((h % 1000) / 1000.0).alias("probe_score"), F.lit(0.4).alias("baseline"),
        F.when(h % 11 == 0, 0.98).otherwise((h % 997) / 997.0).alias("signal"), ((h % 103) / 102.0).alias("top_share"),
    )


@query("eligible_targets", f"""select dataset, rank, position, "column", kind, missing_pct, unique_count, balance from (select *,
  row_number() over (partition by dataset order by round((100.0::double - missing_pct) / 100.0::double + balance, 9) desc, position) as rank from
  (select * exclude (balance), case when kind = 'categorical' then balance else 1.0::double end as balance from {CANDIDATES}
   where kind in ('numeric', 'categorical') and missing_pct <= 30 and unique_count >= 2 and (kind = 'numeric' or unique_count <= 20)))
  where rank <= 30""")
def eligible_targets(spark, d):
    df = candidates(spark, d)
    return TG.eligible_targets(df.drop("balance"), df.select("dataset", "column", "balance"), by=["dataset"])


SCORED = f"""(select *, caution is not null as derived_like, caution is null and score >= 55 and signal >= 0.15 as recommended from
  (select *, greatest(blend - case caution when 'DUPLICATE' then 40 when 'DERIVED' then 40 when 'NEAR_DUPLICATE' then 25 else 0 end, 0) as score from
  (select *, round_even(55 * signal + 20 * (100.0::double - missing_pct) / 100.0::double + 15 * balance + 10 * case when task = 'regression'
     or unique_count = 2 then 1.0::double when unique_count <= 10 then 0.7::double else 0.3::double end, 0)::int as blend,
   case when probe_score >= 0.99 and top_share >= 0.9 then 'DUPLICATE' when probe_score >= 0.99 then 'DERIVED'
     when top_share >= 0.9 and signal >= 0.75 then 'NEAR_DUPLICATE' end as caution from {CANDIDATES})))"""


@query("score_targets", f'select "column", caution, score, derived_like, recommended from {SCORED}')
def score_targets(spark, d):
    return TG.score_targets(candidates(spark, d)).select("column", "caution", "score", "derived_like", "recommended")


@query("target_reasons", f"""select "column", concat_ws(' ',
    case caution when 'DUPLICATE' then 'One column explains it almost perfectly; they may be the same thing.'
      when 'DERIVED' then 'It looks computed from the other columns.'
      when 'NEAR_DUPLICATE' then 'One column explains nearly all of it; check that they differ.' end,
    case when signal < 0.15 then 'The other columns say little about it.'
      when task = 'classification' then 'Predicted right in ' || round(probe_score * 100)::int || '% of rows against ' || round(baseline * 100)::int || '% by guessing.'
      else 'The other columns explain ' || round(greatest(probe_score, 0) * 100)::int || '% of its variation.' end,
    case when task = 'classification' and unique_count = 2 then 'Two outcomes only.' end,
    case when task = 'classification' and balance < 0.5 then 'One value dominates.' end,
    case when missing_pct = 0 then 'Always filled in.' when missing_pct > 5 then 'Missing in ' || round(missing_pct)::int || '% of rows.' end) as reasons
  from {SCORED}""")
def target_reasons(spark, d):
    return TG.target_reasons(TG.score_targets(candidates(spark, d))).select("column", F.array_join("reasons", " ").alias("reasons"))


@query("grade_targets", f"""select "column", case when score >= 75 then 'Excellent' when score >= 55 then 'Good' when score >= 40 then 'Fair'
  else 'Weak' end as grade, score from {SCORED} order by recommended desc, derived_like, score desc, "column" limit 6""")
def grade_targets(spark, d):
    return TG.grade_targets(TG.score_targets(candidates(spark, d))).select("column", "grade", "score")


@query("rate_datasets", f"""with s as {SCORED}, b as (select * from s qualify row_number() over (partition by dataset order by derived_like, score desc,
  "column" desc) = 1), p as (select dataset, max(row_count) as rows, count(*) as columns, count_if(kind in ('id_like', 'unsupported')) as unusable,
  count_if(kind in ('numeric', 'categorical') and missing_pct > 50) as sparse from s group by 1)
  select p.dataset, b."column" as best_target, p.rows, p.columns, p.unusable, p.sparse, case when b."column" is null or signal < 0.05 or rows < 50 then 'poor'
  when signal >= 0.5 and rows >= 500 and score >= 70 then 'great' when signal < 0.2 or rows < 300 then 'fair' else 'good' end as rating
  from p left join b on p.dataset = b.dataset""")
def rate_datasets(spark, d):
    df = candidates(spark, d)
    return TG.rate_datasets(df, TG.score_targets(df), ["dataset"]).drop("points")


@query("probe_target", "select 'y' as target, 'regression' as task, 'l_quantity' as strongest, true as clear_signal union all select 'l_returnflag', 'classification', null, false")
def probe_target(spark, d):
    df = _number_rows(spark, d).drop("l_orderkey", "l_partkey", "l_suppkey")
    profiles = column_profiles(df)
    shared = TG.probe_table(df, profiles, ["l_linenumber", "l_quantity", "l_discount", "l_tax", "y"])
    found = [TG.probe_target(shared, n) for n in ("y", "l_returnflag")]
    shared.close()
    rows = [(p.column, p.task, p.predictors[0][0] if p.signal > 0.15 and p.predictors else None, p.signal > 0.5) for p in found]
    return spark.createDataFrame(rows, "target string, task string, strongest string, clear_signal boolean")


@query("analyze")
def analyze(spark, d):
    df = _class_rows(spark, d)
    return TG.analyze(df, ["o_orderkey"]).candidates.select("column", "task", "score", "signal", "derived_like", "recommended")


IDEA_BASES = ["l_quantity", "l_extendedprice", "l_discount"]


def _ideas_sql():
    forms = [("per", "/"), ("times", "*"), ("minus", "-")]
    pairs = [(a, b) for i, a in enumerate(IDEA_BASES) for b in IDEA_BASES[i + 1:]]
    return " union all ".join(
        f"""select '{a}_{w}_{b}' as name, '{a} {o} {b}' as formula, round(1 - count(v)::double / count(*), 9) as missing_share,
        1 - count(v)::double / count(*) <= 0.3 and min(v) < max(v) as usable
        from (select {f'{a} / nullif({b}, 0)' if o == '/' else f'{a} {o} {b}'} as v from {fx.GAPPY_LINEITEM} where l_returnflag is not null)"""
        for a, b in pairs for w, o in forms)


@query("idea_candidates", _ideas_sql())
def idea_candidates(spark, d):
    df = fx.gappy_lineitem(spark, d).select("l_returnflag", *IDEA_BASES)
    spec = build_feature_spec(df, "l_returnflag")
    out = TG.idea_candidates(df, spec, [("l_quantity", 0.5), ("l_extendedprice", 0.3), ("l_discount", 0.2)])
    return out.select("name", "formula", F.round("missing_share", 9).alias("missing_share"), "usable")


@query("feature_ideas", "select 'l_extendedprice_per_l_quantity' as best_idea")
def feature_ideas(spark, d):
    df = table(spark, d, "lineitem").select(
        "l_quantity", "l_extendedprice", (F.col("l_extendedprice") / F.col("l_quantity") + fx.noise(*fx.LINE_KEY)).alias("unit_price"))
    spec = build_feature_spec(df, "unit_price")
    out = TG.feature_ideas(df, spec, [("l_extendedprice", 0.6), ("l_quantity", 0.4)])
    return out.agg(F.max_by("name", "share").alias("best_idea"))


# ------------------------------------------------------------------ runs

RUN_FEATURES = """(select o_custkey as run_id, o_orderkey as feature, o_orderpriority as source,
  (o_orderkey % 40) / 1000.0::double as share, o_custkey % 5 <> 0 as is_dataset_column from orders)"""


def run_features(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("feature"), F.col("o_orderpriority").alias("source"),
        ((F.col("o_orderkey") % 40) / 1000.0).alias("share"), (F.col("o_custkey") % 5 != 0).alias("is_dataset_column"))


@query("suggest_exclusions", f"""select run_id, source, share from (select *, count(*) over (partition by run_id) - count_if(weak) over (partition by run_id) as kept
  from (select run_id, source, max(share) as share, max(share) < 0.01 and bool_or(is_dataset_column) as weak from {RUN_FEATURES} group by 1, 2))
  where weak and kept >= 2""")
def suggest_exclusions(spark, d):
    return R.suggest_exclusions(run_features(spark, d))


@query("leak_suspect", f"""select run_id, source from {RUN_FEATURES} where feature % 9 = 0 and is_dataset_column""")
def leak_suspect(spark, d):
    features = run_features(spark, d)
    code = F.when(F.col("feature") % 9 == 0, "POSSIBLE_LEAKAGE").otherwise("CLASS_IMBALANCE").alias("code")
    warnings = features.select("run_id", code, F.col("feature").alias("column"))
    return R.leak_suspect(warnings, features)


RUNS = """(select o_orderkey as run_id, o_orderpriority as target, case when o_custkey % 2 = 0 then 'classification' else 'regression' end as task,
  case o_orderstatus when 'F' then 'complete' when 'O' then 'failed' else 'queued' end as status,
  case when o_orderkey % 10 <> 0 and o_orderstatus = 'F' then floor(o_totalprice / 5000) / 100 end as score, o_orderdate as created_at,
  case when o_orderkey % 4 = 0 then 'mine' end as label, case when o_orderkey % 4 = 1 then '{}' end as overrides,
  case when o_orderkey % 4 = 2 then 'thorough' else 'standard' end as effort from orders)"""


def runs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("run_id"), F.col("o_orderpriority").alias("target"),
        F.when(F.col("o_custkey") % 2 == 0, "classification").otherwise("regression").alias("task"),
        F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "failed").otherwise("queued").alias("status"),
        F.when((k % 10 != 0) & (F.col("o_orderstatus") == "F"), F.floor(F.col("o_totalprice") / 5000) / 100).alias("score"),
        F.col("o_orderdate").alias("created_at"), F.when(k % 4 == 0, "mine").alias("label"), F.when(k % 4 == 1, "{}").alias("overrides"),
        F.when(k % 4 == 2, "thorough").otherwise("standard").alias("effort"))


@query("rank_runs", f"""select run_id, row_number() over (order by case when status = 'queued' then 0 when status = 'complete' then 1 else 2 end,
  score desc nulls last, created_at desc, run_id) as position, case when label is not null then label when overrides is not null then 'Fine-tuned'
  when effort = 'thorough' then 'Thorough search' else 'Standard' end as shown_label from {RUNS}""")
def rank_runs(spark, d):
    return R.rank_runs(runs(spark, d), per_bucket=2000).select("run_id", "position", "shown_label")


@query("best_run", f"""select target, task, runs, run_id, score from (select *, count(*) over (partition by target, task) as runs,
  row_number() over (partition by target, task order by score desc, run_id) as r from {RUNS} where status = 'complete' and score is not null)
  where r = 1 and runs >= 2 order by runs desc, target, task limit 1""")
def best_run(spark, d):
    return R.best_run(runs(spark, d))


@query("record_and_list_runs", "select 2 as runs, 'complete' as latest_status, round(avg(o_totalprice), 4) as score from orders")
def record_and_list_runs(spark, d):
    path = TR.scratch_path(spark, "io")
    score = table(spark, d, "orders").agg(F.avg("o_totalprice")).first()[0]
    at = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)
    first = R.record_run(spark, path, R.run_row("orders", "o_totalprice", "regression", "queued", created_at=at))
    R.record_run(spark, path, R.run_row("orders", "o_totalprice", "regression", "complete", metrics={"r2": score}, run_id=first, created_at=at))
    R.record_run(spark, path, R.run_row("orders", "o_orderstatus", "classification", "failed", error="x", created_at=at))
    out = R.list_runs(spark, path, "orders")
    return out.agg(F.count(F.lit(1)).cast("int").alias("runs"), F.max(F.when(F.col("run_id") == first, F.col("status"))).alias("latest_status"),
                   F.round(F.max("score"), 4).alias("score"))


@query("compare_variants", "select 'Simple' as label, 'complete' as status union all select 'Standard', 'complete' union all select 'Thorough', 'complete'")
def compare_variants(spark, d):
    out = R.compare_variants(_class_rows(spark, d), "orders", "won", ["o_orderkey"], T.Params(learning_rate=0.3, max_depth=4, n_estimators=50),
                             exclude=("o_orderkey",), cross_validation=False, with_linear=False)
    return out.select("label", "status")


@query("run_tables", f"""select n::bigint as confusion_rows, 4 as confusion_cells, 21 as curve_points, n::bigint as calibrated_rows,
  true as same_accuracy, true as recall_falls from (select {HELD.format(fx.PLANTED_ORDERS, 'won')} as n)""")
def run_tables(spark, d):
    """Confusion counts, threshold curve and calibration of the held-out rows of a run."""
    r = trained(spark, d, "class")
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("rows"))) / F.sum("rows")
    confusion = r.confusion().agg(F.sum("rows").alias("confusion_rows"), F.count(F.lit(1)).cast("int").alias("confusion_cells"),
                                  (F.abs(right - F.lit(r.metrics["accuracy"])) < 1e-9).alias("same_accuracy"))
    recalls = F.transform(F.sort_array(F.collect_list(F.struct("threshold", "recall"))), lambda x: x["recall"])
    falls = F.forall(F.sequence(F.lit(1), F.lit(20)), lambda i: F.get("o", i) <= F.get("o", i - 1))
    curve = r.curve().agg(recalls.alias("o")).select(F.size("o").alias("curve_points"), falls.alias("recall_falls"))
    calibrated = r.calibration().agg(F.sum("count").alias("calibrated_rows"))
    return confusion.crossJoin(curve).crossJoin(calibrated)  # one row each


@query("model_report")
def model_report(spark, d):
    r = trained(spark, d, "class")
    return R.model_report(spark, r, X.impact_summary(r.model, _class_rows(spark, d)))


@query("fine_tune", "select true as inherits, true as keeps_target")
def fine_tune(spark, d):
    run = dict(zip([c.split()[0] for c in R.RUN_SCHEMA.split(", ")], R.run_row(
        "orders", "won", "classification", "complete", excluded=("o_orderkey",), overrides=T.Overrides(max_depth=3))))
    result = R.fine_tune_from(_class_rows(spark, d), run, T.Overrides(learning_rate=0.3), ["o_orderkey"],
                              params=FAST, cross_validation=False, with_linear=False)
    return spark.createDataFrame([(result.params.max_depth == 3 and result.params.learning_rate == 0.3, result.model.spec.target == "won")],
                                 "inherits boolean, keeps_target boolean")


@query("retrain_without", "select true as left_out, true as weaker")
def retrain_without(spark, d):
    base = trained(spark, d, "class")
    result = R.retrain_without(_class_rows(spark, d), "won", ["o_orderkey"], ["o_orderkey"], "o_totalprice", [], params=FAST,
                               cross_validation=False, with_linear=False)
    return spark.createDataFrame([("o_totalprice" not in result.model.spec.names, result.metrics["accuracy"] < base.metrics["accuracy"])],
                                 "left_out boolean, weaker boolean")
