"""Column profiles: kind, type, missing and distinct counts, statistics, common values.

Reading is columnar: the counting aggregate makes one pass, and the exact distinct
counts read each column once more, grouped by storage type so that no value is
turned into text just to be counted.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.functions.scalars import (
    column,
    dtype_of,
    is_flag,
    is_integral,
    is_number,
    is_plain,
    is_text,
    is_time,
    parse_dates,
    sanitize_numeric,
)
from tabscout.operators.quantiles import exact_quantiles

# Thresholds that decide a column's kind and its warnings.
FEW_DISTINCT = 10
DENSE_ID_DISTINCT_SHARE = 0.95
DENSE_ID_SPAN_SHARE = 0.8
TEXT_ID_DISTINCT_SHARE = 0.5
DATE_TEXT_SHARE = 0.9
HIGH_MISSING_PCT = 50.0
TOP_VALUES = 20
FACT_COLUMNS_PER_JOB = 60

TOP_TYPE = T.ArrayType(
    T.StructType([T.StructField("value", T.StringType()), T.StructField("count", T.LongType())])
)
PROFILE_SCHEMA = T.StructType(
    [
        T.StructField("position", T.IntegerType()),
        T.StructField("column", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("dtype", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("missing_count", T.LongType()),
        T.StructField("missing_pct", T.DoubleType()),
        T.StructField("unique_count", T.LongType()),
        T.StructField("min", T.DoubleType()),
        T.StructField("max", T.DoubleType()),
        T.StructField("mean", T.DoubleType()),
        T.StructField("median", T.DoubleType()),
        T.StructField("top_values", TOP_TYPE),
    ]
)


@dataclass(frozen=True)
class ColumnProfile:
    """What is known about one column; a table has one of these per column."""

    position: int
    name: str
    kind: str
    dtype: str
    rows: int
    missing: int
    unique: int
    low: float | None = None
    high: float | None = None
    mean: float | None = None
    median: float | None = None
    quartiles: tuple[float, float] | None = None
    top: tuple[tuple[str, int], ...] = field(default=())

    @property
    def present(self) -> int:
        return self.rows - self.missing

    @property
    def missing_pct(self) -> float:
        return round(100.0 * self.missing / self.rows, 1) if self.rows else 0.0


def type_family(dtype: T.DataType) -> str:
    if is_flag(dtype):
        return "flag"
    if is_integral(dtype):
        return "integer"
    if is_number(dtype):
        return "double"
    if is_time(dtype):
        return "timestamp"
    if is_text(dtype):
        return "text"
    return "other"


def dtype_label(dtype: T.DataType) -> str:
    """The stored type by name; zoned and zoneless timestamps read the same."""
    return "timestamp" if isinstance(dtype, T.TimestampNTZType) else dtype.simpleString()


FAMILY_CAST = {
    "flag": "string",
    "integer": "bigint",
    "double": "double",
    "timestamp": "timestamp",
    "text": "string",
    "other": "string",
}


def long_values(df: DataFrame, names: list[str], cast: str) -> DataFrame:
    """Rows of (column index, value) for columns sharing one storage type."""
    slots = [column(n).cast(cast).alias(f"_{i}") for i, n in enumerate(names)]
    wide = df.select(*slots)
    pairs = ", ".join(f"{i}, _{i}" for i in range(len(names)))
    return wide.select(F.expr(f"stack({len(names)}, {pairs}) as (slot, value)")).filter("value is not null")


def frequencies(df: DataFrame, names: list[str], cast: str) -> DataFrame:
    """(slot, value, n): how often each value occurs. Map-side combined, so a value
    held by a third of the rows crosses the shuffle once per task."""
    return long_values(df, names, cast).groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))


def _short(value: Column, cast: str) -> Column:
    """Long texts by their MD5: a distinct count need not shuffle documents."""
    return F.when(F.length(value.cast("string")) > 32, F.md5(value.cast("string"))).otherwise(value) if cast == "string" else value


def distinct_counts(df: DataFrame, names: list[str], approximate: bool = False) -> dict[str, int]:
    """Distinct non-null values per column."""
    if not names:
        return {}
    if approximate:
        row = df.agg(*[F.approx_count_distinct(_countable(df, n)).alias(f"d{i}") for i, n in enumerate(names)]).first()
        return {n: row[f"d{i}"] for i, n in enumerate(names)}
    families: dict[str, list[str]] = {}
    for name in names:
        families.setdefault(FAMILY_CAST[type_family(dtype_of(df, name))], []).append(name)
    result = dict.fromkeys(names, 0)
    parts = []
    for cast, members in families.items():
        plain = df.select(*[_short(_countable(df, m), cast).alias(m) for m in members])
        part = frequencies(plain, members, cast).groupBy("slot").agg(F.count(F.lit(1)).alias("unique"))
        parts.append(part.select(F.lit(cast).alias("family"), "slot", "unique"))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionAll(part)
    for row in table.collect():  # one row per column
        result[families[row["family"]][row["slot"]]] = row["unique"]
    return result


def _countable(df: DataFrame, name: str) -> Column:
    """Arrays, structs and binary are counted through their JSON or hex text."""
    dtype = dtype_of(df, name)
    if is_plain(dtype):
        return column(name)
    if isinstance(dtype, T.BinaryType):
        return F.hex(column(name))
    return F.to_json(F.struct(column(name).alias("v"))) if not _is_null_type(dtype) else F.lit(None).cast("string")


def _is_null_type(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NullType)


def _fact_exprs(df: DataFrame, name: str, i: int) -> list[Column]:
    dtype = dtype_of(df, name)
    c = column(name)
    exprs = [F.count(c).alias(f"n{i}")]
    if is_number(dtype):
        number = c.cast("double")
        exprs += [F.min(c).alias(f"low{i}"), F.max(c).alias(f"high{i}"), F.avg(number).alias(f"mean{i}")]
    if is_text(dtype):
        exprs.append(F.count_if(parse_dates(c).isNotNull()).alias(f"dates{i}"))
    return exprs


def classify_kind(family: str, present: int, unique: int, low=None, high=None,
                  dates: int = 0) -> str:
    """The semantic kind of a column from its counts.

    The date test looks at all present values, so it does not depend on row order. Plain
    numbers kept as text match no date layout, so they never count as dates.
    """
    if present == 0 or family == "other":
        return "unsupported"
    if family == "flag":
        return "categorical"
    if family == "timestamp":
        return "datetime"
    if family in ("integer", "double"):
        if unique <= FEW_DISTINCT:
            return "categorical"
        if family == "integer" and unique / present > DENSE_ID_DISTINCT_SHARE:
            if unique / (high - low + 1) >= DENSE_ID_SPAN_SHARE:
                return "id_like"
        return "numeric"
    if dates / present >= DATE_TEXT_SHARE:
        return "datetime"
    if unique > FEW_DISTINCT and unique / present > TEXT_ID_DISTINCT_SHARE:
        return "id_like"
    return "categorical"


def column_facts(df: DataFrame, approximate_distinct: bool = False) -> list[ColumnProfile]:
    """Kind, counts and ranges of every column: two scans, one small row per column back."""
    df = sanitize_numeric(df)
    names = df.columns
    total = None
    facts: dict[int, dict] = {}
    for start in range(0, len(names), FACT_COLUMNS_PER_JOB):
        batch = list(enumerate(names))[start:start + FACT_COLUMNS_PER_JOB]
        exprs = [F.count(F.lit(1)).alias("total")]
        for i, name in batch:
            exprs += _fact_exprs(df, name, i)
        row = df.agg(*exprs).first().asDict()
        total = row["total"]
        for i, _ in batch:
            facts[i] = {k: row.get(f"{k}{i}") for k in ("n", "low", "high", "mean", "dates")}
    unique = distinct_counts(df, names, approximate_distinct)
    profiles = []
    for i, name in enumerate(names):
        dtype = dtype_of(df, name)
        fact = facts[i]
        kind = classify_kind(type_family(dtype), fact["n"], unique[name], fact["low"], fact["high"],
                             fact["dates"] or 0)
        numeric = kind == "numeric"
        profiles.append(
            ColumnProfile(
                position=i,
                name=name,
                kind=kind,
                dtype=dtype_label(dtype),
                rows=total,
                missing=total - fact["n"],
                unique=unique[name],
                low=float(fact["low"]) if numeric else None,
                high=float(fact["high"]) if numeric else None,
                mean=fact["mean"] if numeric else None,
            )
        )
    return profiles


def column_profiles(df: DataFrame, top_k: int = TOP_VALUES, approximate_distinct: bool = False,
                    quartiles: bool = False) -> list[ColumnProfile]:
    """Facts plus exact medians (numeric kinds) and the most common values (categorical).

    ``quartiles`` finds the outer quartiles in the same passes as the median.
    """
    df = sanitize_numeric(df)
    facts = column_facts(df, approximate_distinct)
    numeric = [p for p in facts if p.kind == "numeric"]
    shares = [0.5, 0.25, 0.75] if quartiles else [0.5]
    medians = exact_quantiles(df, [p.name for p in numeric], shares, {p.name: p.present for p in numeric})
    labels = [p.name for p in facts if p.kind == "categorical"]
    tops: dict[str, list[tuple[str, int]]] = {}
    if labels:
        for row in top_values(df, labels, top_k).orderBy("column", "rank").collect():  # <= k rows per column
            tops.setdefault(row["column"], []).append((row["value"], row["count"]))
    return [
        ColumnProfile(
            **{
                **p.__dict__,
                "median": medians[p.name][0] if p.name in medians else None,
                "quartiles": tuple(medians[p.name][1:]) or None if p.name in medians else None,
                "top": tuple(tops.get(p.name, ())),
            }
        )
        for p in facts
    ]


def profile_table(spark, profiles: list[ColumnProfile]) -> DataFrame:
    rows = [
        (p.position, p.name, p.kind, p.dtype, p.rows, p.missing, p.missing_pct, p.unique, p.low, p.high, p.mean,
         p.median, list(p.top) if p.kind == "categorical" else None)
        for p in profiles
    ]
    return spark.createDataFrame(rows, PROFILE_SCHEMA)


def profile(df: DataFrame, top_k: int = TOP_VALUES, approximate_distinct: bool = False) -> DataFrame:
    """One row per column describing it."""
    return profile_table(df.sparkSession, column_profiles(df, top_k, approximate_distinct))


def numeric_stats(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """min, max, mean and exact median of numeric columns, one row each."""
    df = sanitize_numeric(df)
    names = names or [f.name for f in df.schema.fields if is_number(f.dataType)]
    exprs = []
    for i, n in enumerate(names):
        c = column(n).cast("double")
        exprs += [F.count(c).alias(f"n{i}"), F.min(c).alias(f"a{i}"), F.max(c).alias(f"b{i}"), F.avg(c).alias(f"m{i}")]
    row = df.agg(*exprs).first()
    medians = exact_quantiles(df, names, [0.5], {n: row[f"n{i}"] for i, n in enumerate(names)})
    rows = [(n, row[f"a{i}"], row[f"b{i}"], row[f"m{i}"], medians[n][0]) for i, n in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "column string, min double, max double, mean double, median double")


def top_values(df: DataFrame, names: list[str] | None = None, k: int = TOP_VALUES) -> DataFrame:
    """The k most common values of each column as text, ties by value.

    Ranking runs per column over already counted values; ``rank <= k`` lets Spark cut
    each task's rows to k per column before the shuffle.
    """
    df = sanitize_numeric(df)
    names = names or df.columns
    labels = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
    order = Window.partitionBy("slot").orderBy(F.desc("n"), F.asc("value"))
    return (
        frequencies(df, names, "string")
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select(F.element_at(labels, F.col("slot")).alias("column"), "rank", "value", F.col("n").alias("count"))
    )


def profile_warnings(profiles: DataFrame) -> DataFrame:
    """At most one warning per column; the first rule that applies wins."""
    name, kind, missing = F.col("column"), F.col("kind"), F.col("missing_pct")
    code = (
        F.when(kind == "id_like", "ID_LIKE_COLUMN")
        .when(kind == "unsupported", "ALL_NULL_COLUMN")
        .when(kind == "datetime", "DATETIME_COLUMN")
        .when(missing > HIGH_MISSING_PCT, "HIGH_MISSING")
    )
    text = (
        F.when(kind == "id_like", F.format_string('"%s" behaves like an identifier; models skip it.', name))
        .when(kind == "unsupported", F.format_string('"%s" holds no values; it is ignored.', name))
        .when(
            kind == "datetime",
            F.format_string('"%s" holds dates; models see year, month and weekday.', name),
        )
        .otherwise(
            F.format_string('"%s" lacks %.0f%% of its values; models skip it.', name, missing)
        )
    )
    return (
        profiles.withColumn("code", code)
        .filter(F.col("code").isNotNull())
        .select("position", "column", "code", text.alias("message"))
    )


def category_balance(df: DataFrame, names: list[str], k: int = TOP_VALUES) -> DataFrame:
    """Entropy of the common values over its maximum: 1 is even, 0 is one value only."""
    counts = top_values(df, names, k)
    totals = counts.groupBy("column").agg(
        F.sum("count").alias("total"),
        F.sum(F.col("count") * F.ln("count")).alias("weighted"),
        F.count(F.lit(1)).alias("levels"),
    )
    # -sum(p ln p) written with p = count / total
    entropy = F.ln("total") - F.col("weighted") / F.col("total")
    return totals.select(
        "column", F.when(F.col("levels") > 1, entropy / F.ln("levels")).otherwise(0.0).alias("balance")
    )


def balance_of(profile_: ColumnProfile) -> float:
    """Same measure from a finished profile; numeric columns count as balanced."""
    import math

    if profile_.kind != "categorical" or not profile_.top:
        return 1.0
    total = sum(n for _, n in profile_.top)
    if len(profile_.top) < 2:
        return 0.0
    entropy = -sum(n / total * math.log(n / total) for _, n in profile_.top)
    return entropy / math.log(len(profile_.top))
