"""How strongly columns relate: Pearson r, correlation ratio, Cramér's V.

A whole matrix needs three jobs whatever its size: one aggregate for number pairs, one
grouped pass for category-number pairs and one for category pairs. Pairs are exploded
from each row and combined map-side, so what is shuffled is bounded by the number of
distinct value pairs, not by rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.functions.scalars import column, dtype_of, is_flag, is_number, sanitize_numeric

# Fixed value: pairs with fewer complete rows have no measure.
MIN_PAIR_ROWS = 3
NUMBER_PAIRS_PER_JOB = 120


def _clip(value: Column, low: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(1.0))


def correlation(x: Column, y: Column) -> Column:
    """Pearson r as an aggregate; NULL for a constant side, where ``corr`` would divide by zero."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def _pearson_expr(a: Column, b: Column) -> Column:
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a), F.when(both, b)
    usable = (F.count_if(both) >= MIN_PAIR_ROWS) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    r = correlation(a, b)
    return F.when(usable & ~F.isnan(r), _clip(r, -1.0))


def pearson(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: signed correlation over rows holding both values, or NULL."""
    df = sanitize_numeric(df)
    return df.agg(_pearson_expr(column(a).cast("double"), column(b).cast("double")).alias("value"))


def _ratio_from_groups(groups: DataFrame, by: list[str]) -> DataFrame:
    """sqrt(between / total) from per-group count, mean and centred squares."""
    total = groups.groupBy(*by).agg(
        F.sum("n").alias("rows"),
        F.count(F.lit(1)).alias("levels"),
        (F.sum(F.col("n") * F.col("mean")) / F.sum("n")).alias("grand"),
        F.sum(F.col("n") * F.col("spread")).alias("within"),
    )
    join = groups.join(total, by) if by else groups.crossJoin(F.broadcast(total))  # one row without keys
    between = join.groupBy(*by).agg(
        F.sum(F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)).alias("between"),
        F.first("within").alias("within"),
        F.first("rows").alias("rows"),
        F.first("levels").alias("levels"),
    )
    whole = F.col("between") + F.col("within")
    usable = (F.col("rows") >= MIN_PAIR_ROWS) & (F.col("levels") >= 2) & (whole > 0)
    return between.select(*by, F.when(usable, _clip(F.sqrt(F.col("between") / whole), 0.0)).alias("value"))


def correlation_ratio(df: DataFrame, category: str, number: str) -> DataFrame:
    """One row: how much of a number's variation its category explains (0..1), or NULL."""
    df = sanitize_numeric(df)
    groups = (
        df.select(column(category).cast("string").alias("k"), column(number).cast("double").alias("x"))
        .filter("k is not null and x is not null")
        .groupBy("k")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("spread"))
    )
    return _ratio_from_groups(groups, [])


def _v_from_cells(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cramér's V from the counts of occurring value pairs.

    chi² / n = sum(o² / (row · col)) − 1, which accounts for the empty cells.
    """
    rows = cells.groupBy(*by, "x").agg(F.sum("o").alias("row_n"))
    cols = cells.groupBy(*by, "y").agg(F.sum("o").alias("col_n"))
    levels = (
        rows.groupBy(*by).agg(F.count(F.lit(1)).alias("x_levels"), F.sum("row_n").alias("total"))
    )
    y_levels = cols.groupBy(*by).agg(F.count(F.lit(1)).alias("y_levels"))
    filled = cells.join(rows, [*by, "x"]).join(cols, [*by, "y"])
    share = F.col("o") / F.col("row_n") * (F.col("o") / F.col("col_n"))
    inertia = filled.groupBy(*by).agg(F.sum(share).alias("inertia"))
    if by:
        merged = inertia.join(levels, by).join(y_levels, by)
    else:
        # Single-row tables on both sides.
        merged = inertia.crossJoin(F.broadcast(levels)).crossJoin(F.broadcast(y_levels))
    smaller = F.least("x_levels", "y_levels")
    v = F.sqrt(F.greatest(F.col("inertia") - 1, F.lit(0.0)) / (smaller - 1))
    usable = (F.col("total") >= MIN_PAIR_ROWS) & (smaller >= 2)
    return merged.select(*by, F.when(usable, _clip(v, 0.0)).alias("value"))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: association of two categories (0..1), or NULL."""
    df = sanitize_numeric(df)
    cells = (
        df.select(column(a).cast("string").alias("x"), column(b).cast("string").alias("y"))
        .filter("x is not null and y is not null")
        .groupBy("x", "y")
        .agg(F.count(F.lit(1)).alias("o"))
    )
    return _v_from_cells(cells, [])


def is_categorical(df: DataFrame, name: str) -> bool:
    dtype = dtype_of(df, name)
    return is_flag(dtype) or not is_number(dtype)


def association_matrix(df: DataFrame, names: list[str], categorical: list[str] | None = None,
                       digits: int | None = 3) -> DataFrame:
    """Every ordered pair of columns with its measure, both halves and the diagonal.

    ``signed`` is true for number pairs. ``categorical`` overrides the choice by type.
    """
    df = sanitize_numeric(df)
    spark = df.sparkSession
    labels = [n for n in names if (n in categorical if categorical is not None else is_categorical(df, n))]
    numbers = [n for n in names if n not in labels]
    upper = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    parts: list[DataFrame] = []

    number_pairs = [(a, b) for a, b in upper if a in numbers and b in numbers]
    found = []
    for start in range(0, len(number_pairs), NUMBER_PAIRS_PER_JOB):
        batch = number_pairs[start:start + NUMBER_PAIRS_PER_JOB]
        row = df.agg(
            *[
                _pearson_expr(column(a).cast("double"), column(b).cast("double")).alias(f"r{i}")
                for i, (a, b) in enumerate(batch)
            ]
        ).first()
        found += [(a, b, row[f"r{i}"], True) for i, (a, b) in enumerate(batch)]
    if found:
        parts.append(spark.createDataFrame(found, "a string, b string, value double, signed boolean"))

    mixed = [(a, b) for a, b in upper if (a in labels) != (b in labels)]
    if mixed:
        # Rows are repeated once per category column and carry all numbers along.
        slots = [
            F.struct(
                F.lit(i).alias("slot"), column(k).cast("string").alias("k"),
                *[column(x).cast("double").alias(f"x{j}") for j, x in enumerate(numbers)],
            )
            for i, k in enumerate(labels)
        ]
        stats = [
            e
            for j in range(len(numbers))
            for e in (F.count(f"x{j}").alias(f"n{j}"), F.avg(f"x{j}").alias(f"mean{j}"), F.var_pop(f"x{j}").alias(f"spread{j}"))
        ]
        levels = df.select(F.explode(F.array(*slots)).alias("s")).select("s.*").filter("k is not null").groupBy("slot", "k").agg(*stats)
        each = F.array(*[
            F.struct(F.lit(j).alias("number"), F.col(f"n{j}").alias("n"), F.col(f"mean{j}").alias("mean"), F.col(f"spread{j}").alias("spread"))
            for j in range(len(numbers))
        ])
        groups = levels.select("slot", F.explode(each).alias("e")).select("slot", "e.*").filter("n > 0")
        groups = groups.withColumn("pair", F.col("slot") * len(numbers) + F.col("number")).drop("slot", "number")
        numbered = {i * len(numbers) + j: (k, x) for i, k in enumerate(labels) for j, x in enumerate(numbers)}
        back = {frozenset(p): p for p in mixed}
        parts.append(_named(_ratio_from_groups(groups, ["pair"]), {i: back[frozenset(p)] for i, p in numbered.items()}))

    label_pairs = [(a, b) for a, b in upper if a in labels and b in labels]
    if label_pairs:
        slots = [
            F.struct(
                F.lit(i).alias("pair"), column(a).cast("string").alias("x"), column(b).cast("string").alias("y")
            )
            for i, (a, b) in enumerate(label_pairs)
        ]
        cells = (
            df.select(F.explode(F.array(*slots)).alias("s")).select("s.*")
            .filter("x is not null and y is not null")
            .groupBy("pair", "x", "y")
            .agg(F.count(F.lit(1)).alias("o"))
        )
        parts.append(_named(_v_from_cells(cells, ["pair"]), dict(enumerate(label_pairs))))

    half = parts[0]
    for part in parts[1:]:
        half = half.unionByName(part)
    # The grid keeps pairs that had no complete rows at all.
    grid = spark.createDataFrame(upper, "a string, b string")
    half = grid.join(half, ["a", "b"], "left")
    value = F.round("value", digits) if digits is not None else F.col("value")
    half = half.select("a", "b", value.alias("value"), F.coalesce("signed", F.lit(False)).alias("signed"))
    mirror = half.filter("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "value", "signed")
    return half.unionByName(mirror)


def _named(values: DataFrame, pairs: dict[int, tuple[str, str]]) -> DataFrame:
    spark = values.sparkSession
    names = spark.createDataFrame([(i, a, b) for i, (a, b) in pairs.items()], "pair int, a string, b string")
    return names.join(values, "pair").select("a", "b", "value", F.lit(False).alias("signed"))
