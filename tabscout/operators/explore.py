"""Distributions and callouts for every column of a table.

Each kind of question is one job over all columns it concerns, never one job per
column: histogram counts, spread statistics, time buckets, duplicates, correlations.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.functions.scalars import as_time, column, sanitize_numeric
from tabscout.operators.associate import correlation
from tabscout.operators.profile import (
    HIGH_MISSING_PCT,
    ColumnProfile,
    column_facts,
    column_profiles,
    long_values,
    profile_table,
    top_values,
)
from tabscout.operators.quantiles import exact_quantiles

# Bin counts and the limits that make a finding worth reporting.
HISTOGRAM_BINS = 20
CATEGORY_BINS = 8
FENCE_REACH = 1.5
DAY_SPAN = 60
MONTH_SPAN = 4 * 365
MAX_TIME_BUCKETS = 60
SKEW_LIMIT = 2.0
SKEW_MIN_ROWS = 20
OUTLIER_LIMIT = 0.05
DOMINANT_LIMIT = 0.95
CORRELATION_LIMIT = 0.85
DUPLICATE_LIMIT = 0.01
MAX_HIGHLIGHTS = 6
PAIRS_PER_JOB = 120
TIME_LABELS = {"day": "yyyy-MM-dd", "month": "yyyy-MM", "year": "yyyy"}


@dataclass
class Exploration:
    """Everything the exploration view shows, as tables."""

    overview: DataFrame
    columns: DataFrame
    bins: DataFrame
    stats: DataFrame
    highlights: DataFrame


def _numeric_names(df: DataFrame, profiles: list[ColumnProfile] | None) -> list[ColumnProfile]:
    profiles = profiles if profiles is not None else column_facts(df)
    return [p for p in profiles if p.kind == "numeric"]


# ---------------------------------------------------------------- histograms


def numeric_histogram(df: DataFrame, bins: int = HISTOGRAM_BINS,
                      profiles: list[ColumnProfile] | None = None) -> DataFrame:
    """Equal-width counts of every numeric column: (column, bin, low, high, count).

    Bin limits are literals known from the profile, so counting is one scan and one
    small aggregate; empty bins are kept.
    """
    df = sanitize_numeric(df)
    chosen = [p for p in _numeric_names(df, profiles) if p.present]
    limits = []
    for slot, p in enumerate(chosen):
        low, high = (p.low, p.high) if p.low < p.high else (p.low - 0.5, p.high + 0.5)
        n = min(bins, max(p.unique, 1))
        limits.append((slot, p.name, low, high, n, (high - low) / n))
    spark = df.sparkSession
    grid_rows = [
        (slot, name, b, low + b * width, high if b == n - 1 else low + (b + 1) * width)
        for slot, name, low, high, n, width in limits
        for b in range(n)
    ]
    schema = "slot int, column string, bin int, low double, high double"
    if not limits:
        return spark.createDataFrame([], schema).select("column", "bin", "low", "high", F.lit(0).cast("bigint").alias("count"))
    edges = spark.createDataFrame(
        [(slot, low, high, n, width) for slot, _, low, high, n, width in limits],
        "slot int, _low double, _high double, _n int, _width double",
    )
    values = long_values(df, [p.name for p in chosen], "double")
    v, low, n, width = F.col("value"), F.col("_low"), F.col("_n"), F.col("_width")
    guess = F.least(F.floor((v - low) / (F.col("_high") - low) * n).cast("int"), n - 1)
    # Floating point can land one bin off at an edge; compare with the edge itself.
    placed = (
        F.when(v < low + F.col("_g") * width, F.col("_g") - 1)
        .when((F.col("_g") < n - 1) & (v >= low + (F.col("_g") + 1) * width), F.col("_g") + 1)
        .otherwise(F.col("_g"))
    )
    counted = (
        values.join(F.broadcast(edges), "slot")  # one row per column
        .withColumn("_g", guess)
        .withColumn("bin", placed)
        .groupBy("slot", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
    )
    grid = spark.createDataFrame(grid_rows, schema)
    return grid.join(counted, ["slot", "bin"], "left").select(
        "column", "bin", "low", "high", F.coalesce("count", F.lit(0)).alias("count")
    )


def distribution_stats(df: DataFrame, profiles: list[ColumnProfile] | None = None) -> DataFrame:
    """Range, centre, spread, adjusted skew and Tukey-fence outliers of numeric columns."""
    df = sanitize_numeric(df)
    chosen = [p for p in _numeric_names(df, profiles) if p.present]
    schema = (
        "column string, n bigint, min double, max double, mean double, median double, "
        "std double, skew double, q1 double, q3 double, outlier_count bigint"
    )
    if not chosen:
        return df.sparkSession.createDataFrame([], schema)
    quart = {p.name: (p.quartiles[0], p.median, p.quartiles[1]) for p in chosen if p.quartiles}
    open_ = [p for p in chosen if not p.quartiles]
    quart |= exact_quantiles(df, [p.name for p in open_], [0.25, 0.5, 0.75], {p.name: p.present for p in open_})
    exprs = []
    for i, p in enumerate(chosen):
        c = column(p.name).cast("double")
        q1, _, q3 = quart[p.name]
        reach = FENCE_REACH * (q3 - q1)
        exprs += [
            F.avg(c).alias(f"mean{i}"),
            F.stddev_samp(c).alias(f"std{i}"),
            F.skewness(c).alias(f"skew{i}"),
            F.count_if((c < q1 - reach) | (c > q3 + reach)).alias(f"out{i}"),
        ]
    row = df.agg(*exprs).first()
    rows = []
    for i, p in enumerate(chosen):
        n = p.present
        skew = row[f"skew{i}"]
        adjusted = skew * (n * (n - 1)) ** 0.5 / (n - 2) if n > 2 and skew is not None else None
        q1, q2, q3 = quart[p.name]
        rows.append(
            (p.name, n, p.low, p.high, row[f"mean{i}"], float(q2), row[f"std{i}"] if n > 1 else 0.0,
             adjusted, float(q1), float(q3), row[f"out{i}"])
        )
    return df.sparkSession.createDataFrame(rows, schema)


def category_bins(df: DataFrame, names: list[str], k: int = CATEGORY_BINS) -> DataFrame:
    """The k most common values per column plus how many rows hold anything else."""
    df = sanitize_numeric(df)
    top = top_values(df, names, k)
    present = df.agg(*[F.count(column(n)).alias(f"c{i}") for i, n in enumerate(names)])
    pairs = ", ".join(f"'{n}', c{i}".replace("\\", "\\\\") for i, n in enumerate(names))
    totals = present.select(F.expr(f"stack({len(names)}, {pairs}) as (column, present)"))
    kept = top.groupBy("column").agg(F.sum("count").alias("kept"))
    other = totals.join(kept, "column", "left").select(
        "column", (F.col("present") - F.coalesce("kept", F.lit(0))).alias("other_count")
    )
    return top.join(other, "column").select("column", "rank", F.col("value").alias("label"), "count", "other_count")


# ---------------------------------------------------------------- time buckets


def time_bins(df: DataFrame, names: list[str]) -> DataFrame:
    """Counts per day, month or year, whichever suits the span of each column.

    Gaps are filled with zeros while the filled range stays within 60 buckets.
    """
    spark = df.sparkSession
    times = {n: as_time(df, n) for n in names}
    spans = df.agg(
        *[e for i, n in enumerate(names) for e in (F.min(times[n]).alias(f"a{i}"), F.max(times[n]).alias(f"b{i}"))]
    )
    # A whole number of days between the ends, as text-free arithmetic in microseconds.
    spans = spans.select(
        *[
            e
            for i in range(len(names))
            for e in (
                F.floor((F.unix_micros(f"b{i}") - F.unix_micros(f"a{i}")) / F.lit(86_400_000_000)).alias(f"d{i}"),
                *[F.trunc(F.col(f"{x}{i}").cast("date"), "year").alias(f"{x}year{i}") for x in "ab"],
                *[F.trunc(F.col(f"{x}{i}").cast("date"), "month").alias(f"{x}month{i}") for x in "ab"],
                *[F.col(f"{x}{i}").cast("date").alias(f"{x}day{i}") for x in "ab"],
            )
        ]
    ).first()
    plans = []  # per column with dates: place, name, unit, first and last period, whether gaps are filled
    for i, n in enumerate(names):
        if spans[f"d{i}"] is not None:
            unit = "day" if spans[f"d{i}"] <= DAY_SPAN else "month" if spans[f"d{i}"] <= MONTH_SPAN else "year"
            ends = spans[f"a{unit}{i}"], spans[f"b{unit}{i}"]
            plans.append((i, n, unit, *ends, _buckets(*ends, unit) <= MAX_TIME_BUCKETS))
    if not plans:
        return spark.createDataFrame([], "column string, unit string, label string, count bigint")
    periods = [times[n].cast("date") if unit == "day" else F.trunc(times[n].cast("date"), unit) for _, n, unit, *_ in plans]
    each = F.array(*[F.struct(F.lit(i).alias("slot"), p.alias("period")) for (i, *_), p in zip(plans, periods)])
    counted = df.select(F.explode(each).alias("s")).filter("s.period is not null").groupBy("s.slot", "s.period").agg(
        F.count(F.lit(1)).alias("count"))
    table = spark.createDataFrame(plans, "slot int, column string, unit string, first date, last date, filled boolean")
    days = {u: F.sequence(F.col("first"), F.col("last"), F.expr(f"interval 1 {u}")) for u in TIME_LABELS}
    every = F.when(F.col("unit") == "day", days["day"]).when(F.col("unit") == "month", days["month"]).otherwise(days["year"])
    # At most MAX_TIME_BUCKETS rows for a filled column, and one row for each other.
    grid = table.filter("filled").select("slot", F.explode(every).alias("period"))
    whole = counted.join(F.broadcast(table), "slot")
    empty = grid.join(counted.select("slot", "period"), ["slot", "period"], "left_anti").join(F.broadcast(table), "slot").withColumn(
        "count", F.lit(0).cast("bigint"))
    label = F.when(F.col("unit") == "day", F.date_format("period", TIME_LABELS["day"])).when(
        F.col("unit") == "month", F.date_format("period", TIME_LABELS["month"])).otherwise(F.date_format("period", TIME_LABELS["year"]))
    shown = ["column", "unit", label.alias("label"), "count"]
    return whole.select(*shown).unionAll(empty.select(*shown))


def _buckets(first, last, unit: str) -> int:
    if unit == "day":
        return (last - first).days + 1
    months = (last.year - first.year) * 12 + last.month - first.month
    return months + 1 if unit == "month" else last.year - first.year + 1


# ---------------------------------------------------------------- whole-table measures


def missing_cells_pct(df: DataFrame) -> DataFrame:
    """Share of empty cells, in percent with one decimal."""
    df = sanitize_numeric(df)
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(column(n)).alias(f"p{i}") for i, n in enumerate(df.columns)]).first()
    cells = row["n"] * len(df.columns)
    empty = cells - sum(row[f"p{i}"] for i in range(len(df.columns)))
    share = round(100.0 * empty / cells, 1) if cells else 0.0
    return df.sparkSession.createDataFrame([(share,)], "missing_cells_pct double")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows.

    One shuffle of 128 bits of hash per row, counted on the map side first, so that a row
    which a third of the table repeats crosses it once per task. The hashes take in which
    cells are missing.
    """
    df = sanitize_numeric(df)
    cells = [e for n in df.columns for e in (column(n).isNull(), column(n))]
    names = [F.xxhash64(F.lit(seed), *cells).alias(f"h{seed}") for seed in (1, 2)]
    groups = df.select(*names).groupBy("h1", "h2").agg((F.count(F.lit(1)) - 1).alias("extra"))
    return groups.agg(F.coalesce(F.sum("extra"), F.lit(0)).alias("duplicate_rows"))


def correlation_pairs(df: DataFrame, names: list[str]) -> DataFrame:
    """Pearson r of every pair of the named columns over rows holding both."""
    df = sanitize_numeric(df)
    pairs = list(combinations(names, 2))
    rows = []
    for start in range(0, len(pairs), PAIRS_PER_JOB):
        batch = pairs[start:start + PAIRS_PER_JOB]
        row = df.agg(
            *[correlation(column(a).cast("double"), column(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(batch)]
        ).first()
        for i, (a, b) in enumerate(batch):
            r = row[f"r{i}"]
            rows.append((start + i, a, b, r if r is not None and r == r else None))
    return df.sparkSession.createDataFrame(rows, "position int, a string, b string, r double")


# ---------------------------------------------------------------- highlights

HIGHLIGHT_SCHEMA = "place int, tone string, code string, column string, other string, value double"


def column_highlights(df: DataFrame, profiles: list[ColumnProfile] | None = None,
                      stats: DataFrame | None = None) -> DataFrame:
    """Long-tailed, outlier-heavy and single-valued columns."""
    df = sanitize_numeric(df)
    profiles = profiles if profiles is not None else column_profiles(df, quartiles=True)
    stats = stats if stats is not None else distribution_stats(df, profiles)
    facts = {r["column"]: r for r in stats.collect()}  # one row per numeric column
    found = []
    for p in profiles:
        if p.kind == "numeric" and p.name in facts:
            s = facts[p.name]
            if s["n"] > SKEW_MIN_ROWS and s["skew"] is not None and abs(s["skew"]) > SKEW_LIMIT:
                found.append((p.position, "info", "SKEWED", p.name, None, float(s["skew"])))
            elif p.rows and s["outlier_count"] / p.rows > OUTLIER_LIMIT:
                found.append((p.position, "info", "OUTLIERS", p.name, None, float(s["outlier_count"])))
        if p.kind == "categorical" and p.top and p.top[0][1] / p.present >= DOMINANT_LIMIT:
            found.append((p.position, "warn", "DOMINANT_VALUE", p.name, p.top[0][0], p.top[0][1] / p.present))
    return df.sparkSession.createDataFrame(found, HIGHLIGHT_SCHEMA)


def correlation_highlights(df: DataFrame, profiles: list[ColumnProfile] | None = None) -> DataFrame:
    """Numeric pairs that carry nearly the same information (|r| at least 0.85)."""
    df = sanitize_numeric(df)
    chosen = [p.name for p in _numeric_names(df, profiles)]
    if len(chosen) < 2:
        return df.sparkSession.createDataFrame([], HIGHLIGHT_SCHEMA)
    return (
        correlation_pairs(df, chosen)
        .filter(F.abs("r") >= CORRELATION_LIMIT)
        .select(
            F.col("position").alias("place"),
            F.lit("info").alias("tone"),
            F.when(F.col("r") > 0, "MOVE_TOGETHER").otherwise("MOVE_OPPOSITE").alias("code"),
            F.col("a").alias("column"),
            F.col("b").alias("other"),
            F.col("r").alias("value"),
        )
    )


def highlights(df: DataFrame, profiles: list[ColumnProfile] | None = None, stats: DataFrame | None = None,
               duplicates: int | None = None) -> DataFrame:
    """Up to six callouts: duplicates first, then columns, then correlated pairs."""
    df = sanitize_numeric(df)
    profiles = profiles if profiles is not None else column_profiles(df, quartiles=True)
    spark = df.sparkSession
    rows = profiles[0].rows if profiles else 0
    if duplicates is None:
        duplicates = duplicate_rows(df).first()["duplicate_rows"]
    repeated = []
    if rows and duplicates / rows > DUPLICATE_LIMIT:
        repeated.append((0, "warn", "DUPLICATE_ROWS", None, None, float(duplicates)))
    parts = [
        spark.createDataFrame(repeated, HIGHLIGHT_SCHEMA),
        column_highlights(df, profiles, stats),
        correlation_highlights(df, profiles),
    ]
    merged = parts[0].withColumn("section", F.lit(0))
    for i, part in enumerate(parts[1:], 1):
        merged = merged.unionByName(part.withColumn("section", F.lit(i)))
    message = (
        F.when(F.col("code") == "DUPLICATE_ROWS", F.format_string("%.0f rows repeat another row exactly.", "value"))
        .when(F.col("code") == "SKEWED", F.format_string('"%s" has a long tail: a few values are far from the rest.', "column"))
        .when(F.col("code") == "OUTLIERS", F.format_string('"%s" has %.0f values beyond its usual range.', "column", "value"))
        .when(
            F.col("code") == "DOMINANT_VALUE",
            F.format_string('"%s" is "%s" in %.0f%% of rows; it may say little.', "column", "other", F.col("value") * 100),
        )
        .otherwise(
            F.format_string('"%s" and "%s" are closely linked (r = %.2f).', "column", "other", "value")
        )
    )
    return (
        merged.withColumn("message", message)
        .orderBy("section", "place", "column", "other")
        .limit(MAX_HIGHLIGHTS)
        .select("section", "place", "tone", "code", "column", "other", "value", "message")
    )


def kind_note(kind: Column, missing_pct: Column) -> Column:
    return (
        F.when(kind == "id_like", "Identifier: models skip it.")
        .when(kind == "unsupported", "No values.")
        .when(kind == "datetime", "Models see year, month and weekday.")
        .when(missing_pct > HIGH_MISSING_PCT, F.format_string("Lacks %.0f%% of its values: models skip it.", missing_pct))
    )


def explore(df: DataFrame, approximate_distinct: bool = False) -> Exploration:
    """The full exploration of a table."""
    df = sanitize_numeric(df)
    spark = df.sparkSession
    profiles = column_profiles(df, approximate_distinct=approximate_distinct, quartiles=True)
    rows = profiles[0].rows if profiles else 0
    duplicates = duplicate_rows(df).first()["duplicate_rows"]
    missing = sum(p.missing for p in profiles)
    cells = rows * len(profiles)
    overview = spark.createDataFrame(
        [(rows, len(profiles), round(100.0 * missing / cells, 1) if cells else 0.0, duplicates)],
        "row_count bigint, column_count int, missing_cells_pct double, duplicate_rows bigint",
    )
    stats = distribution_stats(df, profiles)
    columns = profile_table(spark, profiles).withColumn("note", kind_note(F.col("kind"), F.col("missing_pct")))
    shape = "column string, bin int, label string, low double, high double, count bigint"
    numeric = numeric_histogram(df, profiles=profiles).select(
        "column", "bin", F.format_string("%s–%s", "low", "high").alias("label"), "low", "high", "count"
    )
    labels = []
    for p in profiles:
        if p.kind != "categorical":
            continue
        shown = p.top[:CATEGORY_BINS]
        labels += [(p.name, i, value, None, None, n) for i, (value, n) in enumerate(shown)]
        rest = p.present - sum(n for _, n in shown)
        if rest:
            labels.append((p.name, len(shown), "(other)", None, None, rest))
    bins = numeric.unionByName(spark.createDataFrame(labels, shape))
    dated = [p.name for p in profiles if p.kind == "datetime"]
    if dated:
        times = time_bins(df, dated).select(
            "column", F.lit(None).cast("int").alias("bin"), "label", F.lit(None).cast("double").alias("low"),
            F.lit(None).cast("double").alias("high"), "count",
        )
        bins = bins.unionByName(times)
    return Exploration(overview, columns, bins, stats, highlights(df, profiles, stats, duplicates))
