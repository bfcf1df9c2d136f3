"""Checked queries: sources, cleaning, profiles and exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabscout.operators import explore as X
from tabscout.operators import profile as P
from tabscout.plans import fixtures as fx
from tabscout.plans.registry import query, table

NUMERIC_TYPES = ("bigint", "int", "double")


def one_decimal(x: str) -> str:
    """Round to one decimal from the exact binary value, as the percentages are defined;
    ``round`` would first scale the number and turn 21.149999… into a tie."""
    return f"printf('%.1f', {x})::double"


def facts_sql(source: str, columns: dict[str, str]) -> str:
    """One row per column with counts and kind, from standard SQL."""
    parts = []
    for i, (c, t) in enumerate(columns.items()):
        number = t in NUMERIC_TYPES
        low = f"min({c})::double" if number else "null::double"
        high = f"max({c})::double" if number else "null::double"
        mean = f"avg({c}::double)" if number else "null::double"
        median = f"median({c}::double)" if number else "null::double"
        if t == "timestamp":
            kind = "case when p = 0 then 'unsupported' else 'datetime' end"
        elif t == "string":
            kind = "case when p = 0 then 'unsupported' when u > 10 and u > 0.5 * p then 'id_like' else 'categorical' end"
        elif t == "double":
            kind = "case when p = 0 then 'unsupported' when u <= 10 then 'categorical' else 'numeric' end"
        else:
            kind = ("case when p = 0 then 'unsupported' when u <= 10 then 'categorical' "
                    "when u > 0.95 * p and u >= 0.8 * (hi - lo + 1) then 'id_like' else 'numeric' end")
        parts.append(
            f"select {i} as position, '{c}' as \"column\", {kind} as kind, '{t}' as dtype, n as row_count, "
            f"n - p as missing_count, {one_decimal('100.0::double * (n - p) / n')} as missing_pct, u as unique_count, "
            f"lo, hi, mu, med from (select count(*) as n, count({c}) as p, count(distinct {c}) as u, "
            f"{low} as lo, {high} as hi, {mean} as mu, {median} as med from {source})"
        )
    return " union all ".join(parts)


def profile_sql(source: str, columns: dict[str, str]) -> str:
    shown = "case when kind = 'numeric' then {} end"
    return (
        "select position, \"column\", kind, dtype, row_count, missing_count, missing_pct, unique_count, "
        f"{shown.format('lo')} as \"min\", {shown.format('hi')} as \"max\", "
        f"{shown.format('round(mu, 4)')} as mean, {shown.format('round(med, 4)')} as median "
        f"from ({facts_sql(source, columns)})"
    )


def top_sql(source: str, columns: list[str], k: int) -> str:
    return " union all ".join(
        f"select '{c}' as \"column\", rank, value, count from (select value, count, row_number() over "
        f"(order by count desc, value) as rank from (select cast({c} as varchar) as value, count(*) as count "
        f"from {source} where {c} is not null group by 1)) where rank <= {k}"
        for c in columns
    )


def _profile(df):
    return P.profile(df).drop("top_values").withColumn("mean", F.round("mean", 4)).withColumn(
        "median", F.round("median", 4)
    )


def _register_profiles():
    for name, columns in {
        "lineitem": fx.LINEITEM_COLUMNS, "orders": fx.ORDERS_COLUMNS, "events": fx.EVENTS_COLUMNS,
        "customer": fx.CUSTOMER_COLUMNS, "part": fx.PART_COLUMNS, "documents": fx.DOCUMENTS_COLUMNS,
    }.items():
        query(f"profile_{name}", profile_sql(name, columns))(
            lambda spark, d, name=name: _profile(table(spark, d, name))
        )


_register_profiles()


@query("profile_with_gaps", profile_sql(fx.GAPPY_LINEITEM, fx.LINEITEM_COLUMNS))
def profile_with_gaps(spark, d):
    return _profile(fx.gappy_lineitem(spark, d))


@query("classify_kind", f'select "column", kind from ({facts_sql(fx.GAPPY_LINEITEM, fx.LINEITEM_COLUMNS)}) union all '
       f'select "column", kind from ({facts_sql("orders", fx.ORDERS_COLUMNS)}) union all '
       f'select "column", kind from ({facts_sql("documents", fx.DOCUMENTS_COLUMNS)})')
def classify_kind(spark, d):
    rows = [
        (p.name, p.kind)
        for df in (fx.gappy_lineitem(spark, d), table(spark, d, "orders"), table(spark, d, "documents"))
        for p in P.column_facts(df)
    ]
    return spark.createDataFrame(rows, "column string, kind string")


@query("numeric_stats", " union all ".join(
    f"select '{c}' as \"column\", min({c})::double as \"min\", max({c})::double as \"max\", "
    f"round(avg({c}::double), 4) as mean, round(median({c}::double), 4) as median from {fx.GAPPY_LINEITEM}"
    for c, t in fx.LINEITEM_COLUMNS.items() if t in NUMERIC_TYPES))
def numeric_stats(spark, d):
    stats = P.numeric_stats(fx.gappy_lineitem(spark, d))
    return stats.withColumn("mean", F.round("mean", 4)).withColumn("median", F.round("median", 4))


@query("top_values", top_sql(fx.GAPPY_LINEITEM, ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"], 20))
def top_values(spark, d):
    return P.top_values(fx.gappy_lineitem(spark, d), ["l_returnflag", "l_linestatus", "l_linenumber", "l_suppkey"])


WARN_SQL = """select position, "column", case when kind = 'id_like' then 'ID_LIKE_COLUMN'
  when kind = 'unsupported' then 'ALL_NULL_COLUMN' when kind = 'datetime' then 'DATETIME_COLUMN'
  when missing_pct > 50 then 'HIGH_MISSING' end as code from ({facts})
  where kind in ('id_like', 'unsupported', 'datetime') or missing_pct > 50"""
SPARSE_ORDERS = """(select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate,
  case when o_orderkey % 3 = 0 then o_orderpriority end as o_orderpriority,
  case when o_orderkey < 0 then o_custkey end as empty from orders)"""


@query("profile_warnings", WARN_SQL.format(facts=facts_sql(SPARSE_ORDERS, {**fx.ORDERS_COLUMNS, "empty": "bigint"})))
def profile_warnings(spark, d):
    df = table(spark, d, "orders").withColumn(
        "o_orderpriority", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))
    ).withColumn("empty", F.when(F.col("o_orderkey") < 0, F.col("o_custkey")))
    return P.profile_warnings(P.profile(df)).drop("message")


@query("category_balance", " union all ".join(
    f"select '{c}' as \"column\", round(case when count(*) > 1 then -sum(q * ln(q)) / ln(count(*)) else 0 end, 6) as balance "
    f"from (select count / sum(count) over () as q from ({top_sql(fx.GAPPY_LINEITEM, [c], 20)}))"
    for c in ("l_returnflag", "l_linestatus", "l_linenumber")))
def category_balance(spark, d):
    out = P.category_balance(fx.gappy_lineitem(spark, d), ["l_returnflag", "l_linestatus", "l_linenumber"])
    return out.select("column", F.round("balance", 6).alias("balance"))


# ------------------------------------------------------------------ exploration


def histogram_sql(source: str, columns: dict[str, str], bins: int = 20) -> str:
    """Counts between explicit edges; the last bin is closed on both sides."""
    parts = []
    for c in columns:
        parts.append(f"""select '{c}' as "column", b::int as bin, round(lo + b * w, 6) as low,
          round(case when b = n - 1 then hi else lo + (b + 1) * w end, 6) as high,
          coalesce(cnt, 0) as count from
          (select *, (hi - lo) / n as w from (select case when lo < hi then lo else lo - 0.5 end as lo,
             case when lo < hi then hi else hi + 0.5 end as hi, least({bins}, greatest(u, 1)) as n from
             (select min({c})::double as lo, max({c})::double as hi, count(distinct {c}) as u from {source})))
          cross join range({bins}) r(b)
          left join (select bin, count(*) as cnt from (
             select case when v < lo + g * w then g - 1 when g < n - 1 and v >= lo + (g + 1) * w then g + 1 else g end as bin
             from (select v, lo, w, n, least(floor((v - lo) / (hi - lo) * n), n - 1) as g
               from (select {c}::double as v from {source} where {c} is not null)
               cross join (select *, (hi - lo) / n as w from (select case when lo < hi then lo else lo - 0.5 end as lo,
                 case when lo < hi then hi else hi + 0.5 end as hi, least({bins}, greatest(u, 1)) as n from
                 (select min({c})::double as lo, max({c})::double as hi, count(distinct {c}) as u from {source})))))
             group by 1) h on h.bin = r.b
          where b < n""")
    return " union all ".join(parts)


NUMERIC_LINEITEM = {c: "x" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount")}


def _rounded(df, *names, digits=6):
    for n in names:
        df = df.withColumn(n, F.round(n, digits))
    return df


@query("numeric_histogram", histogram_sql(fx.GAPPY_LINEITEM, NUMERIC_LINEITEM))
def numeric_histogram(spark, d):
    return _rounded(X.numeric_histogram(fx.gappy_lineitem(spark, d).select(*NUMERIC_LINEITEM)), "low", "high")


def stats_sql(source: str, columns) -> str:
    return " union all ".join(
        f"""select '{c}' as "column", n, lo as "min", hi as "max", round(mu, 4) as mean, round(med, 4) as median,
        round(sd, 4) as std, round(sk, 4) as skew, q1, q3,
        (select count(*) from {source} where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1)) as outlier_count
        from (select count({c}) as n, min({c})::double as lo, max({c})::double as hi, avg({c}::double) as mu,
          median({c}::double) as med, stddev_samp({c}::double) as sd, skewness({c}::double) as sk,
          quantile_cont({c}::double, 0.25) as q1, quantile_cont({c}::double, 0.75) as q3 from {source})"""
        for c in columns
    )


@query("distribution_stats", stats_sql(fx.GAPPY_LINEITEM, NUMERIC_LINEITEM))
def distribution_stats(spark, d):
    out = X.distribution_stats(fx.gappy_lineitem(spark, d).select(*NUMERIC_LINEITEM))
    return _rounded(out, "mean", "median", "std", "skew", digits=4)


SQUARED_EVENTS = "(select event_id, user_id, event_type, value, value * value as squared from events)"


def squared_events(spark, d):
    return table(spark, d, "events").select(
        "event_id", "user_id", "event_type", "value", (F.col("value") * F.col("value")).alias("squared")
    )


@query("distribution_stats_events", stats_sql(SQUARED_EVENTS, ["user_id", "value", "squared"]))
def distribution_stats_events(spark, d):
    out = X.distribution_stats(squared_events(spark, d).drop("event_id"))
    return _rounded(out, "mean", "median", "std", "skew", digits=4)


def category_sql(source: str, columns, k: int = 8) -> str:
    return " union all ".join(
        f"""select "column", rank, value as label, count,
        (select count({c}) from {source}) - sum(count) over () as other_count
        from ({top_sql(source, [c], k)})""" for c in columns
    )


@query("category_bins", category_sql(fx.GAPPY_LINEITEM, ["l_returnflag", "l_linestatus", "l_linenumber"]))
def category_bins(spark, d):
    return X.category_bins(fx.gappy_lineitem(spark, d), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("category_bins_part", category_sql("part", ["p_brand", "p_type", "p_name"]))
def category_bins_part(spark, d):
    return X.category_bins(table(spark, d, "part"), ["p_brand", "p_type", "p_name"])


@query("time_bins_yearly", """with s as (select min(year(o_orderdate)) as a, max(year(o_orderdate)) as b from orders)
  select 'o_orderdate' as "column", 'year' as unit, y::varchar as label, (select count(*) from orders where year(o_orderdate) = y) as count
  from (select unnest(range(a, b + 1)) as y from s)""")
def time_bins_yearly(spark, d):
    return X.time_bins(table(spark, d, "orders"), ["o_orderdate"])


@query("time_bins_daily", """with s as (select min(ts)::date as a, max(ts)::date as b from events)
  select 'ts' as "column", 'day' as unit, strftime(y, '%Y-%m-%d') as label,
  (select count(*) from events where ts::date = y::date) as count
  from (select unnest(generate_series(a::timestamp, b::timestamp, interval 1 day)) as y from s)""")
def time_bins_daily(spark, d):
    return X.time_bins(table(spark, d, "events"), ["ts"])


@query("time_bins_monthly", """with t as (select make_date(1996 + year(o_orderdate) % 3, case month(o_orderdate) when 5 then 6 else month(o_orderdate) end, 1)
    as o_orderdate from orders),
  s as (select date_trunc('month', min(o_orderdate)) as a, date_trunc('month', max(o_orderdate)) as b from t)
  select 'o_orderdate' as "column", 'month' as unit, strftime(y, '%Y-%m') as label,
  (select count(*) from t where date_trunc('month', o_orderdate) = y) as count
  from (select unnest(generate_series(a::timestamp, b::timestamp, interval 1 month)) as y from s)""")
def time_bins_monthly(spark, d):
    """All orders, moved into three years without a May."""
    month = F.month("o_orderdate")
    moved = F.make_date(1996 + F.year("o_orderdate") % 3, F.when(month == 5, 6).otherwise(month), F.lit(1))
    return X.time_bins(table(spark, d, "orders").select(moved.alias("o_orderdate")), ["o_orderdate"])


@query("time_bins_together", """with e as (select ts::date as y, count(*) as n from events group by 1), s as (select min(y) as a, max(y) as b from e)
  select 'ts' as "column", 'day' as unit, strftime(p, '%Y-%m-%d') as label, coalesce(n, 0)::bigint as count
  from (select unnest(generate_series(a::timestamp, b::timestamp, interval 1 day))::date as p from s) left join e on y = p
  union all select 'later', 'year', strftime(date_trunc('year', ts + to_days(((event_id % 9) * 400)::int)), '%Y'), count(*) from events group by 3""")
def time_bins_together(spark, d):
    """Two date columns of different spans in one pass."""
    df = table(spark, d, "events").withColumn("later", F.col("ts") + F.make_dt_interval(((F.col("event_id") % 9) * 400).cast("int")))
    return X.time_bins(df.select("ts", "later"), ["ts", "later"])


CELLS_MISSING = " + ".join(f"(case when {c} is null then 1 else 0 end)" for c in fx.LINEITEM_COLUMNS)


@query("missing_cells_pct", f"""select {one_decimal(f'100.0::double * sum({CELLS_MISSING}) / (count(*) * 11)')}
  as missing_cells_pct from {fx.GAPPY_LINEITEM}""")
def missing_cells_pct(spark, d):
    return X.missing_cells_pct(fx.gappy_lineitem(spark, d))


@query("duplicate_rows", """select (select count(*) from lineitem) - (select count(*) from
  (select distinct l_suppkey, l_linenumber, l_quantity, l_returnflag from lineitem)) as duplicate_rows""")
def duplicate_rows(spark, d):
    return X.duplicate_rows(table(spark, d, "lineitem").select("l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"))


SKEWED = "(select *, case when event_id % 50 = 0 then 'rare' else 'usual' end as status, value * 2 + 1 as doubled, " \
         "-user_id * 1.0::double as mirrored from (select event_id, user_id, event_type, value, value * value as squared from events))"


def skewed_events(spark, d):
    return squared_events(spark, d).withColumn(
        "status", F.when(F.col("event_id") % 50 == 0, "rare").otherwise("usual")
    ).withColumn("doubled", F.col("value") * 2 + 1).withColumn("mirrored", -F.col("user_id") * F.lit(1.0))


COLUMN_HIGHLIGHTS_SQL = " union all ".join(
    [f"""select {i} as place, 'info' as tone, code, '{c}' as "column", null::varchar as other, round(v, 6) as value from (
    select case when n > 20 and abs(sk) > 2 then 'SKEWED' when outs > 0.05 * n then 'OUTLIERS' end as code,
      case when n > 20 and abs(sk) > 2 then sk else outs end as v from (
      select n, sk, (select count(*) from {SKEWED} where {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1))::double as outs
      from (select count(*) as n, skewness({c}::double) as sk, quantile_cont({c}::double, 0.25) as q1,
            quantile_cont({c}::double, 0.75) as q3 from {SKEWED}))) where code is not null"""
     for i, c in enumerate(["event_id", "user_id", None, "value", "squared", None, "doubled", "mirrored"]) if c and c != "event_id"]
    + [f"""select 5 as place, 'warn' as tone, 'DOMINANT_VALUE' as code, 'status' as "column", 'usual' as other,
    round(avg(case when status = 'usual' then 1.0::double else 0 end), 6) as value from {SKEWED}
    having avg(case when status = 'usual' then 1.0::double else 0 end) >= 0.95"""])
NUMERIC_SKEWED = ["user_id", "value", "squared", "doubled", "mirrored"]
PAIRS = [(a, b) for i, a in enumerate(NUMERIC_SKEWED) for b in NUMERIC_SKEWED[i + 1:]]
PAIRS_SQL = " union all ".join(
    f"""select {i} as place, 'info' as tone, case when r > 0 then 'MOVE_TOGETHER' else 'MOVE_OPPOSITE' end as code,
    '{a}' as "column", '{b}' as other, round(r, 6) as value from (select corr({a}, {b}) as r from {SKEWED}) where abs(r) >= 0.85"""
    for i, (a, b) in enumerate(PAIRS))


@query("column_highlights", COLUMN_HIGHLIGHTS_SQL)
def column_highlights(spark, d):
    return _rounded(X.column_highlights(skewed_events(spark, d)), "value")


@query("correlation_highlights", PAIRS_SQL)
def correlation_highlights(spark, d):
    return _rounded(X.correlation_highlights(skewed_events(spark, d)), "value")


NARROW = "(select user_id % 20 as bucket, event_type, status from {})".format(SKEWED)


@query("highlights", f"""select section, place, tone, code, "column", other, value from (
  select 0 as section, * from (select 0 as place, 'warn' as tone, 'DUPLICATE_ROWS' as code, null::varchar as "column",
    null::varchar as other, d::double as value from (select count(*) - (select count(*) from (select distinct
    user_id, event_type, value, squared, status, doubled, mirrored from {SKEWED})) as d, count(*) as n from {SKEWED}) where d > 0.01 * n)
  union all select 1 as section, place - 1, tone, code, "column", other, value from ({COLUMN_HIGHLIGHTS_SQL})
  union all select 2 as section, * from ({PAIRS_SQL}))
  order by section, place, "column", other limit 6""")
def highlights(spark, d):
    return _rounded(X.highlights(skewed_events(spark, d).drop("event_id")), "value").drop("message")


@query("correlation_pairs", " union all ".join(
    f"select {i} as position, '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from {fx.GAPPY_LINEITEM}"
    for i, (a, b) in enumerate([("l_quantity", "l_extendedprice"), ("l_quantity", "l_discount"), ("l_quantity", "l_tax"),
                                ("l_extendedprice", "l_discount"), ("l_extendedprice", "l_tax"), ("l_discount", "l_tax")])))
def correlation_pairs(spark, d):
    return _rounded(X.correlation_pairs(fx.gappy_lineitem(spark, d), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), "r")


def explore_table(df):
    """One long table of every bin and statistic, for the flagship check."""
    found = X.explore(df)
    bins = found.bins.select("column", F.lit("bin").alias("item"), F.coalesce("label", F.lit("")).alias("label"),
                             "low", "high", F.col("count").cast("double").alias("value"))
    bins = bins.withColumn("label", F.when(F.col("low").isNotNull(), "").otherwise(F.col("label")))
    numbers = found.stats.select(
        "column",
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value"))
            for n in ("min", "max", "mean", "median", "std", "outlier_count")
        ])).alias("s"),
    ).select("column", "s.item", F.lit("").alias("label"), F.lit(None).cast("double").alias("low"),
             F.lit(None).cast("double").alias("high"), "s.value")
    whole = found.overview.select(
        F.lit("*").alias("column"),
        F.explode(F.array(*[
            F.struct(F.lit(n).alias("item"), F.col(n).cast("double").alias("value"))
            for n in ("row_count", "column_count", "missing_cells_pct", "duplicate_rows")
        ])).alias("s"),
    ).select("column", "s.item", F.lit("").alias("label"), F.lit(None).cast("double").alias("low"),
             F.lit(None).cast("double").alias("high"), "s.value")
    return _rounded(bins.unionByName(numbers).unionByName(whole), "low", "high", "value", digits=4)


EXPLORE_NUMERIC = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount"]
EXPLORE_LABELS = ["l_linenumber", "l_tax", "l_returnflag", "l_linestatus"]
EXPLORE_SQL = " union all ".join(
    [f"""select "column", 'bin' as item, '' as label, round(low, 4) as low, round(high, 4) as high, count::double as value
    from ({histogram_sql('lineitem', dict.fromkeys(EXPLORE_NUMERIC))})"""]
    + [f"""select "column", 'bin' as item, value as label, null as low, null as high, count::double as value
    from ({top_sql('lineitem', [c], 8)})
    union all select '{c}', 'bin', '(other)', null, null, r from (select (select count({c}) from lineitem) - sum(count) as r
    from ({top_sql('lineitem', [c], 8)})) where r > 0""" for c in EXPLORE_LABELS]
    + ["""select 'l_shipdate', 'bin', y::varchar, null, null, (select count(*) from lineitem where year(l_shipdate) = y)::double
    from (select unnest(range(min(year(l_shipdate)), max(year(l_shipdate)) + 1)) as y from lineitem)"""]
    + [f"""select "column", '{item}', '', null, null, round({expr}::double, 4) from ({stats_sql('lineitem', EXPLORE_NUMERIC)})"""
       for item, expr in [("min", '"min"'), ("max", '"max"'), ("mean", "mean"), ("median", "median"), ("std", "std"),
                          ("outlier_count", "outlier_count")]]
    + ["""select '*', 'row_count', '', null, null, count(*)::double from lineitem union all
    select '*', 'column_count', '', null, null, 11 union all select '*', 'missing_cells_pct', '', null, null, 0
    union all select '*', 'duplicate_rows', '', null, null, ((select count(*) from lineitem) -
      (select count(*) from (select distinct * from lineitem)))::double"""]
)


@query("explore_lineitem", EXPLORE_SQL)
def explore_lineitem(spark, d):
    return explore_table(table(spark, d, "lineitem"))
