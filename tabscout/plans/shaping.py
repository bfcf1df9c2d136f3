"""Checked queries: calculated columns, associations, features, splits, time series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscout.functions import scalars as S
from tabscout.functions.formula import add_calculated_column
from tabscout.operators import associate as A
from tabscout.operators import features as FS
from tabscout.operators import series as TS
from tabscout.operators import split as SP
from tabscout.operators.profile import column_facts
from tabscout.plans import fixtures as fx
from tabscout.plans.profiling import top_sql
from tabscout.plans.registry import query, table
from tabscout.operators.trees import scratch_path
from tabscout.sources import tables as IO

# ------------------------------------------------------------------ columns

FORMULAS = {
    "per_unit": ("l_extendedprice / (l_quantity - 1)",
                 "l_extendedprice / nullif(l_quantity - 1, 0)"),
    "net": ("l_extendedprice * (1 - l_discount) + l_tax", "l_extendedprice * (1 - l_discount) + l_tax"),
    "big": ("l_quantity > 25", "coalesce(l_quantity > 25, false)"),
    "returned": ("l_returnflag == 'R'", "coalesce(l_returnflag = 'R', false)"),
    "mixed": ("l_quantity % 7 ** 1 - -l_linenumber", "l_quantity % 7 + l_linenumber"),
    "both": ("l_quantity >= 10 and l_tax < 0.05 or l_returnflag != 'A'",
             "coalesce(l_quantity >= 10, false) and l_tax < 0.05 or coalesce(l_returnflag <> 'A', true)"),
}


@query("calculated_columns", "select l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"{sql} as {name}" for name, (_, sql) in FORMULAS.items()) + f" from {fx.GAPPY_LINEITEM}")
def calculated_columns(spark, d):
    df = fx.gappy_lineitem(spark, d)
    for name, (formula, _) in FORMULAS.items():
        df = add_calculated_column(df, name, formula)
    return df.select(*fx.LINE_KEY, *FORMULAS)


@query("sanitize_numeric", """select o_orderkey, case when o_orderkey % 11 in (0, 1) then null else o_totalprice end as price
  from orders""")
def sanitize_numeric(spark, d):
    k = F.col("o_orderkey") % 11
    df = table(spark, d, "orders").select(
        "o_orderkey",
        F.when(k == 0, float("inf")).when(k == 1, float("nan")).otherwise(F.col("o_totalprice")).alias("price"),
    )
    return S.sanitize_numeric(df)


@query("drop_missing_target", f"""select count(*) as kept, (select count(*) from {fx.GAPPY_LINEITEM} where l_quantity is null)
  as dropped, sum(l_quantity) as total from {fx.GAPPY_LINEITEM} where l_quantity is not null""")
def drop_missing_target(spark, d):
    kept, dropped = FS.drop_missing_target(fx.gappy_lineitem(spark, d), "l_quantity")
    return kept.agg(F.count(F.lit(1)).alias("kept"), F.lit(dropped).cast("bigint").alias("dropped"),
                    F.sum("l_quantity").alias("total"))


@query("exclude_columns", "select c_custkey, c_acctbal, c_mktsegment from customer")
def exclude_columns(spark, d):
    return FS.exclude_columns(table(spark, d, "customer"), ["c_name", "c_nationkey"], "c_mktsegment")


@query("coerce_numeric", """select p_partkey, try_cast(case when p_partkey % 4 = 0 then p_brand
  when p_partkey % 4 = 1 then cast(p_size as varchar) else cast(p_size as varchar) || '.25' end as double) as number from part""")
def coerce_numeric(spark, d):
    size = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    text = F.when(k == 0, F.col("p_brand")).when(k == 1, size).otherwise(F.concat(size, F.lit(".25")))
    return table(spark, d, "part").select("p_partkey", S.coerce_numeric(text).alias("number"))


@query("parse_dates", """select o_orderkey, case when o_orderkey % 5 = 4 then null else o_orderdate::date end as day from orders""")
def parse_dates(spark, d):
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(at, "yyyy-MM-dd")).when(k == 1, F.date_format(at, "MM/dd/yyyy"))
        .when(k == 2, F.date_format(at, "MMM d, yyyy")).when(k == 3, F.date_format(at, "yyyy/MM/dd"))
        .otherwise(F.col("o_orderpriority"))
    )
    return table(spark, d, "orders").select("o_orderkey", S.parse_dates(text).cast("date").alias("day"))


@query("date_part_features", " union all ".join(
    f"""select '{c}_{p}' as feature, '{c}' as source, '{p}' as part, min({e})::double as low, max({e})::double as high,
    median({e})::double as middle from {t} having count(distinct {e}) >= 2"""
    for t, c in (("orders", "o_orderdate"), ("events", "ts"))
    for p, e in (("year", f"year({c})"), ("month", f"month({c})"), ("dayofweek", f"isodow({c}) - 1"))))
def date_part_features(spark, d):
    found = FS.date_part_features(table(spark, d, "orders"), ["o_orderdate"]) + FS.date_part_features(
        table(spark, d, "events"), ["ts"])
    return spark.createDataFrame([(f.name, f.derived_from, f.part, f.low, f.high, f.default) for f in found],
                                 "feature string, source string, part string, low double, high double, middle double")


TOP_BRANDS = "(select p_brand from part group by 1 order by count(*) desc, p_brand limit 10)"


@query("apply_categories", f"""select p_partkey, case when p_brand in {TOP_BRANDS} then p_brand else 'Other' end as brand,
  case when p_type in ('ECONOMY', 'PROMO') then p_type end as kind from part""")
def apply_categories(spark, d):
    df = table(spark, d, "part")
    spec = FS.build_feature_spec(df.select("p_brand", "p_retailprice"), "p_retailprice", "regression", max_categories=10)
    return df.select(
        "p_partkey", FS.apply_categories(F.col("p_brand"), spec.feature("p_brand").categories).alias("brand"),
        FS.apply_categories(F.col("p_type"), ("ECONOMY", "PROMO")).alias("kind"),
    )


def _flat_spec(spark, spec):
    return FS.spec_table(spark, spec).select(
        "position", "feature", "kind", "source", "part", F.array_join("options", "|").alias("options"),
        "min_value", "max_value", F.when(F.col("kind") == "numeric", F.format_string("%.4f", F.col("default_value").try_cast("double")))
        .otherwise(F.col("default_value")).alias("default_value"), "excluded_reason")


def _num(position: int, c: str, source: str) -> str:
    return f"""select {position} as position, '{c}' as feature, 'numeric' as kind, '{c}' as source, null as part, null as options,
      min({c})::double as min_value, max({c})::double as max_value, printf('%.4f', median({c}::double)) as default_value,
      null as excluded_reason from {source}"""


def _cat(position: int, c: str, source: str, k: int = 50) -> str:
    return f"""select {position}, '{c}', 'categorical', '{c}', null, string_agg(value, '|' order by rank), null, null,
      max(case when rank = 1 then value end), null from ({top_sql(source, [c], k)})"""


def _part(position: int, c: str, p: str, e: str, source: str) -> str:
    return f"""select {position}, '{c}_{p}', 'numeric', '{c}', '{p}', null, min({e})::double, max({e})::double,
      printf('%.4f', median({e})::double), null from {source}"""




@query("build_feature_spec", " union all ".join([
    _num(0, "l_partkey", fx.GAPPY_LINEITEM), _num(1, "l_suppkey", fx.GAPPY_LINEITEM),
    _num(2, "l_quantity", fx.GAPPY_LINEITEM), _num(3, "l_extendedprice", fx.GAPPY_LINEITEM),
    _num(4, "l_discount", fx.GAPPY_LINEITEM), _cat(5, "l_returnflag", fx.GAPPY_LINEITEM),
    _cat(6, "l_linestatus", fx.GAPPY_LINEITEM),
    _part(7, "l_shipdate", "year", "year(l_shipdate)", fx.GAPPY_LINEITEM),
    _part(8, "l_shipdate", "month", "month(l_shipdate)", fx.GAPPY_LINEITEM),
    _part(9, "l_shipdate", "dayofweek", "isodow(l_shipdate) - 1", fx.GAPPY_LINEITEM),
    """select null, 'l_orderkey', null, 'l_orderkey', null, null, null, null, null, 'user_excluded'""",
    """select null, 'l_tax', null, 'l_tax', null, null, null, null, null, 'user_excluded'""",
]))
def build_feature_spec(spark, d):
    spec = FS.build_feature_spec(fx.gappy_lineitem(spark, d), "l_linenumber", user_excluded=("l_orderkey", "l_tax"))
    return _flat_spec(spark, spec)


@query("input_spec", f"""select 0 as position, 'o_orderstatus' as name, 'categorical' as kind, null::double as min_value,
  null::double as max_value, string_agg(value, '|' order by rank) as options from ({top_sql('orders', ['o_orderstatus'], 50)})
  union all select 1, 'o_totalprice', 'numeric', min(o_totalprice), max(o_totalprice), null from orders""")
def input_spec(spark, d):
    df = table(spark, d, "orders").select("o_orderstatus", "o_totalprice", "o_orderpriority")
    spec = FS.build_feature_spec(df, "o_orderpriority")
    out = FS.input_spec(spark, spec).withColumn("options", F.array_join("options", "|"))
    return out.select("position", "name", "kind", "min_value", "max_value", "options")


@query("apply_feature_spec", """select p_partkey, p_size::double as p_size, case when p_brand in (select p_brand from part
  group by 1 order by count(*) desc, p_brand limit 12) then p_brand else 'Other' end as p_brand, p_type as p_type,
  null::double as made_year from part""")
def apply_feature_spec(spark, d):
    df = table(spark, d, "part")
    spec = FS.build_feature_spec(df.select("p_size", "p_brand", "p_type", "p_retailprice"), "p_retailprice", max_categories=12)
    # "made" is not in the table: its feature must come out missing.
    absent = FS.Feature("made_year", "numeric", derived_from="made", part="year")
    spec = FS.FeatureSpec(spec.target, spec.task, (*spec.features, absent))
    return FS.apply_feature_spec(df, spec, [F.col("p_partkey")])


@query("fill_defaults", """select o_orderkey, coalesce(case when o_orderkey % 3 <> 0 then o_totalprice end, m) as o_totalprice,
  coalesce(case when o_orderkey % 4 <> 0 then o_orderstatus end, s) as o_orderstatus from orders
  cross join (select median(o_totalprice) as m from orders)
  cross join (select o_orderstatus as s from orders group by 1 order by count(*) desc, 1 limit 1)""")
def fill_defaults(spark, d):
    df = table(spark, d, "orders")
    spec = FS.build_feature_spec(df.select("o_totalprice", "o_orderstatus", "o_orderpriority"), "o_orderpriority")
    scenarios = df.select(
        "o_orderkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice").cast("string")).alias("o_totalprice"),
        F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
    )
    return FS.fill_defaults(scenarios, spec, keep=("o_orderkey",))


@query("flag_out_of_range", """select o_orderkey, concat_ws(',', case when p < lo or p > hi then 'o_totalprice' end) as outside
  from (select o_orderkey, o_totalprice * case when o_orderkey % 2 = 0 then 2 else 1 end as p from orders)
  cross join (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders)""")
def flag_out_of_range(spark, d):
    df = table(spark, d, "orders")
    spec = FS.build_feature_spec(df.select("o_totalprice", "o_orderpriority"), "o_orderpriority")
    asked = df.select("o_orderkey", (F.col("o_totalprice") * F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(1)).alias("o_totalprice"))
    return FS.flag_out_of_range(asked, spec).select("o_orderkey", F.array_join("out_of_range", ",").alias("outside"))


@query("normalize_01", """select c_custkey, round((c_acctbal - lo) / (hi - lo), 4) as place from customer
  cross join (select min(c_acctbal) as lo, max(c_acctbal) as hi from customer)""")
def normalize_01(spark, d):
    return S.normalize_01(table(spark, d, "customer"), "c_acctbal", "place").select("c_custkey", "place")


@query("detect_task", " union all ".join(
    f"select '{c}' as target, case when {int(t == 'string')} = 1 or count(distinct {c}) <= 10 then 'classification' "
    f"else 'regression' end as task from lineitem" for c, t in fx.LINEITEM_COLUMNS.items() if t != "timestamp"))
def detect_task(spark, d):
    df = table(spark, d, "lineitem")
    facts = {p.name: p.unique for p in column_facts(df)}
    return spark.createDataFrame(
        [(c, FS.detect_task(df, c, facts[c])) for c, t in fx.LINEITEM_COLUMNS.items() if t != "timestamp"],
        "target string, task string")


# ------------------------------------------------------------------ associations


@query("pearson", f"select round(corr(l_quantity, y), 6) as value from {fx.PLANTED_LINEITEM}")
def pearson(spark, d):
    return A.pearson(fx.planted_lineitem(spark, d), "l_quantity", "y").select(F.round("value", 6).alias("value"))


def ratio_sql(source: str, k: str, x: str) -> str:
    return f"""(select sqrt(sum(n * (mu - grand) * (mu - grand)) / max(tot)) from
      (select {k} as k, count(*) as n, avg({x}::double) as mu from {source} where {k} is not null and {x} is not null group by 1)
      cross join (select avg({x}::double) as grand, var_pop({x}::double) * count(*) as tot from {source}
        where {k} is not null and {x} is not null))"""


def v_sql(source: str, a: str, b: str) -> str:
    return f"""(select sqrt(greatest(sum(o * 1.0::double * o / r / c) - 1, 0) / (least(count(distinct x), count(distinct y)) - 1))
      from (select x, y, o, sum(o) over (partition by x) as r, sum(o) over (partition by y) as c from
      (select {a} as x, {b} as y, count(*) as o from {source} where {a} is not null and {b} is not null group by 1, 2)))"""


@query("correlation_ratio", f"select round({ratio_sql(fx.PLANTED_LINEITEM, 'band', 'l_quantity')}, 6) as value")
def correlation_ratio(spark, d):
    return A.correlation_ratio(fx.planted_lineitem(spark, d), "band", "l_quantity").select(F.round("value", 6).alias("value"))


@query("cramers_v", f"select round({v_sql(fx.PLANTED_ORDERS, 'o_orderpriority', 'won')}, 6) as value")
def cramers_v(spark, d):
    return A.cramers_v(fx.planted_orders(spark, d), "o_orderpriority", "won").select(F.round("value", 6).alias("value"))


MATRIX = {"l_quantity": 0, "l_discount": 0, "y": 0, "band": 1, "l_returnflag": 1, "l_linestatus": 1}


def _matrix_sql():
    names = list(MATRIX)
    parts = []
    for i, a in enumerate(names):
        for b in names[i:]:
            if MATRIX[a] and MATRIX[b]:
                e, signed = v_sql(fx.PLANTED_LINEITEM, a, b), "false"
            elif not MATRIX[a] and not MATRIX[b]:
                e, signed = f"(select corr({a}, {b}) from {fx.PLANTED_LINEITEM} where {a} is not null and {b} is not null)", "true"
            else:
                k, x = (a, b) if MATRIX[a] else (b, a)
                e, signed = ratio_sql(fx.PLANTED_LINEITEM, k, x), "false"
            for p, q in {(a, b), (b, a)}:
                parts.append(f"select '{p}' as a, '{q}' as b, round({e}, 5) as value, {signed} as signed")
    return " union all ".join(parts)


@query("association_matrix", _matrix_sql())
def association_matrix(spark, d):
    return A.association_matrix(fx.planted_lineitem(spark, d), list(MATRIX), digits=5)


# ------------------------------------------------------------------ splits

H_ORDERS = fx.hash_sql("o_orderkey")


@query("random_split", f"""select o_orderkey, rn <= floor((n * 200 + 999) / 1000) as is_test from (select o_orderkey,
  row_number() over (order by {H_ORDERS}) as rn, count(*) over () as n from orders)""")
def random_split(spark, d):
    return SP.random_split(table(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "is_test")


@query("random_split_stratified", f"""select o_orderkey, rn <= floor((n * 200 + 999) / 1000) as is_test from (select o_orderkey,
  row_number() over (partition by o_orderstatus order by {H_ORDERS}) as rn, count(*) over (partition by o_orderstatus) as n
  from orders)""")
def random_split_stratified(spark, d):
    return SP.random_split(table(spark, d, "orders"), ["o_orderkey"], stratify="o_orderstatus").select("o_orderkey", "is_test")


@query("validation_slice", f"""select o_orderkey, rn <= floor((n * 100 + 999) / 1000) as is_validation from (select o_orderkey,
  row_number() over (partition by o_orderpriority order by {H_ORDERS}) as rn, count(*) over (partition by o_orderpriority) as n
  from (select *, row_number() over (order by {H_ORDERS}) as r0, count(*) over () as n0 from orders)
  where r0 > floor((n0 * 200 + 999) / 1000))""")
def validation_slice(spark, d):
    train = SP.random_split(table(spark, d, "orders"), ["o_orderkey"]).filter("not is_test")
    return SP.validation_slice(train, ["o_orderkey"], stratify="o_orderpriority").select("o_orderkey", "is_validation")


@query("kfold_column", f"""select o_orderkey, floor((rn - 1) * 5 / n)::int as fold from (select o_orderkey,
  row_number() over (partition by o_orderstatus order by {H_ORDERS}) as rn, count(*) over (partition by o_orderstatus) as n
  from orders)""")
def kfold_column(spark, d):
    return SP.kfold_column(table(spark, d, "orders"), ["o_orderkey"], stratify="o_orderstatus").select("o_orderkey", "fold")


@query("cap_rows", f"select o_orderkey, o_totalprice from orders order by {H_ORDERS} limit 1234")
def cap_rows(spark, d):
    return SP.cap_rows(table(spark, d, "orders"), 1234, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("cap_rows_recent", "select o_orderkey, o_totalprice from orders order by o_orderdate desc, o_orderkey desc limit 1234")
def cap_rows_recent(spark, d):
    return SP.cap_rows(table(spark, d, "orders"), 1234, ["o_orderkey"], time="o_orderdate").select("o_orderkey", "o_totalprice")


ORDERED = "(select *, row_number() over (order by o_orderdate, o_orderkey) - 1 as i, count(*) over () as n from orders)"


@query("time_split", f"""select o_orderkey, case when i < (n * 800) // 1000 - 30 then 'train' when i < (n * 800) // 1000 then 'gap'
  else 'test' end as part from {ORDERED}""")
def time_split(spark, d):
    return SP.time_split(table(spark, d, "orders"), "o_orderdate", ["o_orderkey"], gap=30).select("o_orderkey", "part")


@query("time_validation_slice", f"""select o_orderkey, j >= (m * 900) // 1000 as is_validation from
  (select o_orderkey, i as j, (n * 800) // 1000 as m from {ORDERED} where i < (n * 800) // 1000)
  where j < (m * 900) // 1000 - 7 or j >= (m * 900) // 1000""")
def time_validation_slice(spark, d):
    train = SP.time_split(table(spark, d, "orders"), "o_orderdate", ["o_orderkey"]).filter("part = 'train'")
    out = SP.validation_slice(train, ["o_orderkey"], time="o_orderdate", gap=7)
    return out.select("o_orderkey", "is_validation")


@query("walk_forward_folds", f"""select fold, o_orderkey, case when i < n - (5 - fold) * (n // 6) - 10 then 'train' else 'test' end as role
  from {ORDERED} cross join (select unnest(range(5)) as fold)
  where i < n - (5 - fold) * (n // 6) - 10 or (i >= n - (5 - fold) * (n // 6) and i < n - (4 - fold) * (n // 6))""")
def walk_forward_folds(spark, d):
    out = SP.walk_forward_folds(table(spark, d, "orders"), "o_orderdate", ["o_orderkey"], gap=10)
    return out.select("fold", "o_orderkey", "role")


# ------------------------------------------------------------------ time series


@query("lag_features", """select o_orderkey, round(lag(o_totalprice, 1) over w, 4) as o_totalprice_lag1,
  round(lag(o_totalprice, 2) over w, 4) as o_totalprice_lag2, round(lag(o_totalprice, 3) over w, 4) as o_totalprice_lag3
  from orders window w as (order by o_orderdate, o_orderkey)""")
def lag_features(spark, d):
    out = TS.lag_features(table(spark, d, "orders"), "o_orderdate", "o_totalprice", ["o_orderkey"], per_bucket=2000)
    return out.select("o_orderkey", *[F.round(f"o_totalprice_lag{k}", 4).alias(f"o_totalprice_lag{k}") for k in (1, 2, 3)])


@query("lag_features_text", """select event_id, lag(event_type, 1) over w as event_type_lag1, lag(event_type, 2) over w as event_type_lag2,
  lag(event_type, 3) over w as event_type_lag3 from events window w as (partition by user_id order by ts, event_id)""")
def lag_features_text(spark, d):
    out = TS.lag_features(table(spark, d, "events"), "ts", "event_type", ["event_id"], series="user_id", per_bucket=700)
    return out.select("event_id", "event_type_lag1", "event_type_lag2", "event_type_lag3")


GAPPY_EVENTS = "(select *, case when event_id % 13 <> 0 then value end as v from events)"


@query("trailing_mean", f"""select event_id, case when count(v) over w = 5 then round(avg(v) over w, 6) end as v_avg5
  from {GAPPY_EVENTS} window w as (partition by user_id order by ts, event_id rows between 5 preceding and 1 preceding)""")
def trailing_mean(spark, d):
    df = table(spark, d, "events").withColumn("v", F.when(F.col("event_id") % 13 != 0, F.col("value")))
    out = TS.trailing_mean(df, "ts", "v", ["event_id"], series="user_id")
    return out.select("event_id", F.round("v_avg5", 6).alias("v_avg5"))


@query("prepare_time_frame", """with dated as (select * from events where event_id % 9 <> 0)
  select event_id, round(lag(value, 1) over w, 6) as lag1, round(lag(value, 2) over w, 6) as lag2,
  round(lag(value, 3) over w, 6) as lag3,
  case when count(value) over t = 5 then round(avg(value) over t, 6) end as avg5,
  (select count(*) from events where event_id % 9 = 0) as dropped
  from dated window w as (order by day, event_id), t as (order by day, event_id rows between 5 preceding and 1 preceding)"""
       .replace("select * from events", "select *, ts::date as day from events"))
def prepare_time_frame(spark, d):
    df = table(spark, d, "events").withColumn(
        "day", F.when(F.col("event_id") % 9 != 0, F.date_format("ts", "MM/dd/yyyy")).otherwise("soon"))
    frame, _, dropped = TS.prepare_time_frame(df, "day", "value", ["event_id"], per_bucket=1500)
    return frame.select(
        "event_id", *[F.round(f"value_lag{k}", 6).alias(f"lag{k}") for k in (1, 2, 3)],
        F.round("value_avg5", 6).alias("avg5"), F.lit(dropped).cast("bigint").alias("dropped"))


@query("typical_step", """select floor(median(gap))::bigint as step_micros from (select epoch_us(ts) - epoch_us(lag(ts) over (order by ts)) as gap
  from events) where gap is not null""")
def typical_step(spark, d):
    return TS.typical_step(table(spark, d, "events"), "ts", per_bucket=1500)


@query("future_dates", """with days as (select distinct ts::date as day from events),
  step as (select median(gap) as s from (select day - lag(day) over (order by day) as gap from days) where gap is not null)
  select k as step, strftime((select max(day) from days) + (k * (select s from step))::int, '%Y-%m-%d') as date
  from (select unnest(range(1, 15)) as k)""")
def future_dates(spark, d):
    days = table(spark, d, "events").select(F.to_date("ts").alias("day")).distinct()
    return TS.future_dates(days, "day", 14).select("step", "date")


DAILY = "(select ts::date as day, sum(value) as total, avg(value) * 300 as guess from events group by 1)"


@query("append_future", f"""with h as {DAILY} select day as date, round(total, 4) as actual, round(guess, 4) as predicted,
  case when day = (select max(day) from h) then round(guess, 4) end as forecast, null::double as low, null::double as high from h
  union all select day + 30, null, null, round(guess + 1, 4), round(guess, 4), round(guess + 2, 4) from h""")
def append_future(spark, d):
    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day")).agg(
        F.sum("value").alias("total"), (F.avg("value") * 300).alias("predicted"))
    forecast = daily.select(F.date_add("day", 30).alias("date"), (F.col("predicted") + 1).alias("predicted"),
                            F.col("predicted").alias("low"), (F.col("predicted") + 2).alias("high"))
    out = TS.append_future(daily, forecast, "day", "total")
    return out.select(F.to_date("date").alias("date"), *[F.round(c, 4).alias(c) for c in
                                                         ("actual", "predicted", "forecast", "low", "high")])


# ------------------------------------------------------------------ sources


@query("read_csv", """select n_nationkey, n_name || case when n_nationkey % 3 = 0 then chr(10) || 'he said "' || n_regionkey || ';"' else '' end
    as n_name, n_regionkey from nation
  union all select c_custkey, c_name || case when c_custkey % 3 = 0 then chr(10) || 'he said "' || c_nationkey || ';"' else '' end, c_nationkey from customer""")
def read_csv(spark, d):
    """Quoted values with line breaks, quotes and the delimiter itself."""
    folder = scratch_path(spark, "io")
    both = table(spark, d, "nation").unionAll(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"))
    said = F.concat("n_name", F.lit('\nhe said "'), F.col("n_regionkey").cast("string"), F.lit(';"'))
    both = both.withColumn("n_name", F.when(F.col("n_nationkey") % 3 == 0, said).otherwise(F.col("n_name")))
    both.write.option("header", True).option("sep", ";").option("escape", '"').csv(folder)
    return IO.read_csv(spark, folder)


@query("sniff_delimiter", """select '|' as delimiter, max(len(regexp_extract_all(concat_ws('|', c_custkey, c_name, c_nationkey, c_acctbal,
  c_mktsegment), '[|]')))::double as per_line, 1.0::double as agreement from customer""")
def sniff_delimiter(spark, d):
    folder = scratch_path(spark, "io")
    table(spark, d, "customer").write.option("header", True).option("sep", "|").csv(folder)
    found = IO.sniff_delimiter(spark, folder)
    return IO.delimiter_counts(spark, folder).filter(F.col("delimiter") == found).select(
        "delimiter", F.col("per_line").cast("double").alias("per_line"), "agreement")


@query("save_dataset", "select count(*) as row_count, sum(c_acctbal)::decimal(18,2)::double as balance, 5 as columns from customer")
def save_dataset(spark, d):
    folder = scratch_path(spark, "io")
    data, about = IO.load_dataset(spark, folder, IO.save_dataset(table(spark, d, "customer"), folder))
    return data.agg(F.count(F.lit(1)).alias("row_count"), F.round(F.sum("c_acctbal"), 2).alias("balance")).crossJoin(
        F.broadcast(about.agg(F.count(F.lit(1)).cast("int").alias("columns"))))


@query("preview", "select * from orders order by o_totalprice, o_orderkey limit 200")
def preview(spark, d):
    return IO.preview(table(spark, d, "orders"), ["o_totalprice", "o_orderkey"], 200)


@query("validation_round_trip", "select o_orderkey, '0' || (o_orderkey % 7)::varchar as code, o_totalprice from orders")
def validation_round_trip(spark, d):
    folder = scratch_path(spark, "io")
    df = table(spark, d, "orders").select(
        "o_orderkey", F.concat(F.lit("0"), (F.col("o_orderkey") % 7).cast("string")).alias("code"), "o_totalprice")
    IO.write_validation(df, folder)
    return IO.read_validation(spark, folder)
