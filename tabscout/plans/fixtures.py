"""Inputs the checked queries share, each with the SQL text of the same table.

The test tables hold no missing values and no learnable signal, so some inputs take
values away by a key rule or add a target planted from a hash of the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout.functions.scalars import hash_key
from tabscout.plans.registry import table


def gappy_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem without quantity on every 7th order and without flag on every 5th."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice", "l_discount", "l_tax",
        F.when(F.col("l_orderkey") % 5 != 0, F.col("l_returnflag")).alias("l_returnflag"),
        "l_linestatus", "l_shipdate",
    )


GAPPY_LINEITEM = """(select l_orderkey, l_partkey, l_suppkey, l_linenumber,
  case when l_orderkey % 7 <> 0 then l_quantity end as l_quantity, l_extendedprice, l_discount, l_tax,
  case when l_orderkey % 5 <> 0 then l_returnflag end as l_returnflag, l_linestatus, l_shipdate from lineitem)"""
LINEITEM_COLUMNS = {
    "l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int",
    "l_quantity": "double", "l_extendedprice": "double", "l_discount": "double", "l_tax": "double",
    "l_returnflag": "string", "l_linestatus": "string", "l_shipdate": "timestamp",
}
ORDERS_COLUMNS = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp", "o_orderpriority": "string",
}
EVENTS_COLUMNS = {
    "event_id": "bigint", "ts": "timestamp", "user_id": "bigint", "event_type": "string", "value": "double",
    "props": "string",
}
CUSTOMER_COLUMNS = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string",
}
PART_COLUMNS = {
    "p_partkey": "bigint", "p_name": "string", "p_brand": "string", "p_type": "string", "p_size": "int",
    "p_retailprice": "double",
}
DOCUMENTS_COLUMNS = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}

LINE_KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def hash_sql(*columns: str) -> str:
    joined = ", ".join(f"cast({c} as varchar)" for c in columns)
    return f"('0x' || substr(md5(concat_ws('|', {joined})), 1, 13))::bigint"


def noise(*columns: str) -> Column:
    """0..99 by key hash, the same in both engines."""
    return (hash_key(*columns) % 100).cast("double")


def noise_sql(*columns: str) -> str:
    return f"({hash_sql(*columns)} % 100)::double"


def planted_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem columns with a number ``y`` that follows quantity and discount, three
    bands of it (``band``), and quantity missing on every 7th order."""
    y = 3 * F.col("l_quantity") + 200 * F.col("l_discount") + noise(*LINE_KEY) / 10
    return (
        table(spark, sf_dir, "lineitem")
        .withColumn("y", y)
        .withColumn("band", F.when(y < 60, "low").when(y < 120, "mid").otherwise("high"))
        .select(*LINE_KEY, "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "y", "band")
        .withColumn("l_quantity", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")))
    )


PLANTED_LINEITEM = f"""(select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  case when l_orderkey % 7 <> 0 then l_quantity end as l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, y,
  case when y < 60 then 'low' when y < 120 then 'mid' else 'high' end as band
  from (select *, 3 * l_quantity + 200 * l_discount + {noise_sql(*LINE_KEY)} / 10 as y from lineitem))"""


def planted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders with an outcome ``won`` driven by price and urgency."""
    urgent = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    score = F.col("o_totalprice") / 1000 + F.when(urgent, 80.0).otherwise(0.0) + noise("o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("won", F.when(score > 290, "yes").otherwise("no"))


PLANTED_ORDERS = f"""(select *, case when o_totalprice / 1000
  + case when o_orderpriority in ('1-URGENT', '2-HIGH') then 80.0 else 0.0 end
  + {noise_sql('o_orderkey')} > 290 then 'yes' else 'no' end as won from orders)"""


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored binary table: probability from the price, outcome from the status."""
    p = F.col("o_totalprice") / 500000
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_orderpriority", "o_orderdate",
        F.when(F.col("o_orderstatus") == "F", "F").otherwise("other").alias("actual"),
        F.when(p >= 0.5, "F").otherwise("other").alias("predicted"),
        p.alias("p"),
    )


SCORED_ORDERS = """(select o_orderkey, o_orderpriority, o_orderdate,
  case when o_orderstatus = 'F' then 'F' else 'other' end as actual,
  case when o_totalprice / 500000 >= 0.5 then 'F' else 'other' end as predicted,
  o_totalprice / 500000 as p from orders)"""


def scored_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scored regression table: price guessed from quantity."""
    return table(spark, sf_dir, "lineitem").select(
        *LINE_KEY, "l_returnflag", "l_linestatus", "l_shipdate",
        F.col("l_extendedprice").alias("actual"), (1000 * F.col("l_quantity")).alias("predicted"),
    )


SCORED_LINEITEM = """(select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate,
  l_extendedprice as actual, 1000 * l_quantity as predicted from lineitem)"""
