"""Checked queries: evaluation tables over scored rows of the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscout.operators import evaluate as E
from tabscout.operators import split as SP
from tabscout.plans import fixtures as fx
from tabscout.plans.profiling import _rounded
from tabscout.plans.registry import query, table

S = fx.SCORED_ORDERS


@query("confusion_matrix", f"""select a.c as actual, b.c as predicted,
  (select count(*) from {S} where actual = a.c and predicted = b.c) as rows
  from (select unnest(['F', 'other', 'never']) as c) a cross join (select unnest(['F', 'other', 'never']) as c) b""")
def confusion_matrix(spark, d):
    return E.confusion_matrix(fx.scored_orders(spark, d), "actual", "predicted", ["F", "other", "never"])


AUC_SQL = f"""(select (sum(case when actual = 'F' then r end) - count_if(actual = 'F') * (count_if(actual = 'F') + 1) / 2.0::double)
  / (count_if(actual = 'F')::double * count_if(actual <> 'F')) from
  (select actual, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0::double as r from {S}))"""
METRICS_SQL = f"""select round((select avg((actual = predicted)::int::double) from {S}), 6) as accuracy,
  round((select sum(support * f1) / sum(support) from (select count_if(actual = c) as support,
    2.0::double * count_if(actual = c and predicted = c) / (count_if(actual = c) + count_if(predicted = c)) as f1
    from {S} cross join (select unnest(['F', 'other']) as c) group by c)), 6) as f1_weighted,
  (select count(*) from {S}) as test_rows, round({AUC_SQL}, 6) as roc_auc"""


@query("classification_metrics", METRICS_SQL)
def classification_metrics(spark, d):
    out = E.classification_metrics(fx.scored_orders(spark, d), "actual", "predicted", "p", "F")
    return _rounded(out, "accuracy", "f1_weighted", "roc_auc")


@query("roc_auc", f"select round({AUC_SQL}, 8) as roc_auc")
def roc_auc(spark, d):
    return _rounded(E.roc_auc(fx.scored_orders(spark, d), "actual", "p", "F", per_bucket=1000), "roc_auc", digits=8)


CURVE_SQL = f"""select round(t, 2) as threshold, round(case when f > 0 then tp::double / f end, 6) as precision,
  round(case when pos > 0 then tp::double / pos else 0 end, 6) as recall, round((tp + n - pos - (f - tp))::double / n, 6) as accuracy,
  round(100.0::double * f / n, 6) as flagged_pct from
  (select t, count(*) as n, count_if(p >= t) as f, count_if(p >= t and actual = 'F') as tp, count_if(actual = 'F') as pos
   from {S} cross join (select case when i = 20 then 1.0::double else i * 0.05::double end as t from range(21) r(i)) group by t)"""


@query("threshold_curve", CURVE_SQL)
def threshold_curve(spark, d):
    out = E.threshold_curve(fx.scored_orders(spark, d), "actual", "p", "F")
    return _rounded(out, "precision", "recall", "accuracy", "flagged_pct")


@query("threshold_at", f"select * from ({CURVE_SQL}) where threshold = 0.6")
def threshold_at(spark, d):
    out = E.threshold_at(E.threshold_curve(fx.scored_orders(spark, d), "actual", "p", "F"), 0.625)
    return _rounded(out, "precision", "recall", "accuracy", "flagged_pct")


CAL_SQL = f"""select bin, avg(p) as predicted, avg((actual = 'F')::int::double) as actual, count(*) as count from
  (select *, (select count(*) from range(1, 10) r(i) where p >= i * 0.1::double)::int as bin from {S}) group by bin"""


@query("calibration", f"select bin, round(predicted, 6) as predicted, round(actual, 6) as actual, count from ({CAL_SQL})")
def calibration(spark, d):
    return _rounded(E.calibration(fx.scored_orders(spark, d), "actual", "p", "F"), "predicted", "actual")


@query("calibration_error", f"""select round(error, 6) as error, round(bias, 6) as bias, case when error < 0.05 then 'well calibrated'
  when error < 0.1 then 'slightly ' || side else 'noticeably ' || side end as verdict from
  (select *, case when bias > 0 then 'overconfident' else 'underconfident' end as side from
  (select sum(abs(predicted - actual) * count) / sum(count) as error, sum((predicted - actual) * count) / sum(count) as bias
   from ({CAL_SQL})))""")
def calibration_error(spark, d):
    points = E.calibration(fx.scored_orders(spark, d), "actual", "p", "F")
    return _rounded(E.calibration_error(points), "error", "bias")


@query("regression_metrics", f"""select round(1 - sum((predicted - actual) ** 2) / (var_pop(actual) * count(*)), 6) as r2,
  round(avg(abs(predicted - actual)), 4) as mae, round(sqrt(avg((predicted - actual) ** 2)), 4) as rmse,
  round(avg(actual), 4) as target_mean, round(stddev_samp(actual), 4) as target_std, count(*) as test_rows from {fx.SCORED_LINEITEM}""")
def regression_metrics(spark, d):
    out = E.regression_metrics(fx.scored_lineitem(spark, d), "actual", "predicted")
    return _rounded(_rounded(out, "r2"), "mae", "rmse", "target_mean", "target_std", digits=4)


TEST_ORDERS = f"""(select *, rn <= floor((n * 200 + 999) / 1000) as is_test from (select *,
  row_number() over (order by {fx.hash_sql('o_orderkey')}) as rn, count(*) over () as n from {fx.PLANTED_ORDERS}))"""


@query("naive_baseline_class", f"""select round(avg((won = (select won from {TEST_ORDERS} where not is_test group by 1
  order by count(*) desc, 1 limit 1))::int::double), 6) as baseline_accuracy from {TEST_ORDERS} where is_test""")
def naive_baseline_class(spark, d):
    df = SP.random_split(fx.planted_orders(spark, d), ["o_orderkey"])
    out = E.naive_baseline(df.filter("not is_test"), df.filter("is_test"), "won", "classification")
    return _rounded(out, "baseline_accuracy")


@query("naive_baseline_number", f"""select round(avg(abs(o_totalprice - m)), 4) as baseline_mae from {TEST_ORDERS}
  cross join (select avg(o_totalprice) as m from {TEST_ORDERS} where not is_test) where is_test""")
def naive_baseline_number(spark, d):
    df = SP.random_split(fx.planted_orders(spark, d), ["o_orderkey"])
    out = E.naive_baseline(df.filter("not is_test"), df.filter("is_test"), "o_totalprice", "regression")
    return _rounded(out, "baseline_mae", digits=4)


RARE = "(select *, case when event_id % 17 = 0 then 'rare' else event_type end as kind from events)"


def rare_events(spark, d):
    return table(spark, d, "events").withColumn(
        "kind", F.when(F.col("event_id") % 17 == 0, "rare").otherwise(F.col("event_type")))


COUNTS_SQL = f"""select label, rows, rows::double / total as share, rows::double / total < 0.1 as rare,
  case when least_rows::double / total < 0.1 then total::double / (k * rows) else 1.0 end as weight from
  (select *, sum(rows) over () as total, count(*) over () as k, min(rows) over () as least_rows from
  (select kind as label, count(*) as rows from {RARE} group by 1))"""


@query("class_counts", f"select label, rows, round(share, 6) as share, rare, round(weight, 6) as weight from ({COUNTS_SQL})")
def class_counts(spark, d):
    return _rounded(E.class_counts(rare_events(spark, d), "kind"), "share", "weight")


@query("class_imbalance", f"""select label, round(share, 6) as share, share < 0.1 as imbalanced from ({COUNTS_SQL})
  order by rows, label limit 1""")
def class_imbalance(spark, d):
    return _rounded(E.class_imbalance(rare_events(spark, d), "kind"), "share")


@query("balanced_weights", f"select event_id, round(weight, 6) as weight from {RARE} join ({COUNTS_SQL}) on kind = label")
def balanced_weights(spark, d):
    return _rounded(E.balanced_weights(rare_events(spark, d), "kind").select("event_id", "weight"), "weight")


def group_sql(source: str, columns: list[str], score: str, task: str) -> str:
    worse = "score < overall - 0.07" if task == "classification" else "overall <> 0 and score > overall * 1.3"
    groups = " union all ".join(
        f"""select '{c}' as "column", value, rows, score from (select *, row_number() over (order by rows desc, value) as rank
        from (select {c}::varchar as value, count(*) as rows, avg({score}) as score from {source} where {c} is not null group by 1))
        where rank <= 12 and rows >= 20""" for c in columns)
    return f"""select "column", value, rows, round(score, 4) as score, round(overall, 4) as overall from ({groups})
      cross join (select avg({score}) as overall from {source}) where {worse}"""


BIASED = f"""(select *, case when o_orderpriority = '3-MEDIUM' and o_orderkey % 3 <> 0 then 'none' else won end as guess,
  month(o_orderdate) as month from {fx.PLANTED_ORDERS})"""


@query("group_check_class", group_sql(BIASED, ["o_orderpriority", "o_orderstatus", "month"], "(won = guess)::int::double", "classification"))
def group_check_class(spark, d):
    df = fx.planted_orders(spark, d).withColumn(
        "guess", F.when((F.col("o_orderpriority") == "3-MEDIUM") & (F.col("o_orderkey") % 3 != 0), "none").otherwise(F.col("won"))
    ).withColumn("month", F.month("o_orderdate"))
    out = E.group_check(df, "classification", "won", "guess", ["o_orderpriority", "o_orderstatus", "month"])
    return _rounded(out, "score", "overall", digits=4)


OFFSET = f"""(select *, y + case when l_returnflag = 'R' then 30 else 5 end as guess from {fx.PLANTED_LINEITEM})"""


@query("group_check_number", group_sql(OFFSET, ["l_returnflag", "l_linestatus", "l_suppkey"], "abs(guess - y)", "regression"))
def group_check_number(spark, d):
    df = fx.planted_lineitem(spark, d).withColumn(
        "guess", F.col("y") + F.when(F.col("l_returnflag") == "R", 30).otherwise(5))
    out = E.group_check(df, "regression", "y", "guess", ["l_returnflag", "l_linestatus", "l_suppkey"])
    return _rounded(out, "score", "overall", digits=4)


# Runs derived from the tables: each customer is a run, its orders are its features.
RUN_METRICS = """(select c_custkey as run_id, case when c_nationkey % 2 = 0 then 'classification' else 'regression' end as task,
  case when c_custkey % 3 = 0 then 0.9995::double else 0.8::double end as score, 0.78::double as linear_score from customer)"""
RUN_SHARES = """(select o_custkey as run_id, case when o_orderkey % 16 = 0 then 'rare' else 'common' end as feature,
  sum(o_totalprice) / sum(sum(o_totalprice)) over (partition by o_custkey) as share from orders group by 1, 2)"""


def run_metrics(spark, d):
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("run_id"),
        F.when(F.col("c_nationkey") % 2 == 0, "classification").otherwise("regression").alias("task"),
        F.when(F.col("c_custkey") % 3 == 0, 0.9995).otherwise(0.8).alias("score"), F.lit(0.78).alias("linear_score"))


def run_shares(spark, d):
    feature = F.when(F.col("o_orderkey") % 16 == 0, "rare").otherwise("common").alias("feature")
    sums = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("run_id"), feature).agg(F.sum("o_totalprice").alias("price"))
    total = sums.groupBy("run_id").agg(F.sum("price").alias("t"))
    return sums.join(total, "run_id").select("run_id", "feature", (F.col("price") / F.col("t")).alias("share"))


@query("check_leakage", f"""select m.run_id, 'POSSIBLE_LEAKAGE' as code, feature as "column" from {RUN_METRICS} m join
  (select run_id, feature, share from {RUN_SHARES} qualify row_number() over (partition by run_id order by share desc, feature) = 1) t
  on m.run_id = t.run_id where score > 0.999 and share >= 0.9""")
def check_leakage(spark, d):
    return E.check_leakage(run_metrics(spark, d), run_shares(spark, d))


@query("check_simple_relationships", f"""select run_id, 'SIMPLE_RELATIONSHIPS' as code from {RUN_METRICS}
  where linear_score >= score - case when task = 'classification' then 0.02::double else 0.03::double end""")
def check_simple_relationships(spark, d):
    return E.check_simple_relationships(run_metrics(spark, d))


@query("validation_frame_class", f"""select o_orderkey, actual, predicted as predicted, round(greatest(p, 1 - p), 4) as confidence,
  actual = predicted as correct from {S}""")
def validation_frame_class(spark, d):
    df = fx.scored_orders(spark, d).select(
        "o_orderkey", "actual", F.col("predicted").alias("label"), F.array(F.lit(1.0) - F.col("p"), F.col("p")).alias("probs"))
    return E.validation_frame(df, "actual", "classification", "label", "probs")


@query("validation_frame_number", f"""select l_orderkey, l_linenumber, l_partkey, l_suppkey, actual, predicted,
  round(predicted, 4) as predicted_model, round(round(predicted, 4) - actual, 4) as error from {fx.SCORED_LINEITEM}""")
def validation_frame_number(spark, d):
    df = fx.scored_lineitem(spark, d).select(*fx.LINE_KEY, "actual", "predicted").withColumn("guess", F.col("predicted"))
    return E.validation_frame(df, "actual", "regression", "guess")
