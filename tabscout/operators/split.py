"""Row caps, train/test splits, validation slices and folds, all without moving rows.

Random splits order rows by a 52-bit hash of their key. The hash at the wanted rank is
found by counting hash prefixes and ranking only the one prefix that holds it, per
class; the split itself is then a comparison on each row. Nothing wide is shuffled, and
a class holding most rows costs no more than the others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabscout.errors import TabularError
from tabscout.functions.scalars import column, hash_key
from tabscout.operators.joins import join_small
from tabscout.operators.ordering import before_rank, cut_points, order_terms

# Split sizes, in thousandths, and fold count.
TEST_PERMILLE = 200
VALIDATION_PERMILLE = 100
FOLDS = 5
HASH_BITS = 52
PREFIX_ROWS = 20_000


def _digits(rows: int) -> int:
    """Hash digits so that one prefix holds about 20 thousand rows."""
    return max(1, min(5, math.ceil(math.log(max(rows / PREFIX_ROWS, 1.0)) / math.log(16)) or 1))


def hash_cutoffs(df: DataFrame, key: list[str], stratum: Column | None, ranks: dict[str, Column],
                 rows: int | None = None, hashed: Column | None = None) -> DataFrame:
    """Per stratum, the hash value at 1-based ranks given as columns of its size ``n``.

    Returns ``stratum, n`` and one bigint column per entry of ``ranks``; a rank below 1
    yields −1, so nothing sorts at or under it. ``hashed`` is the key's hash where the table has it.
    """
    rows = df.count() if rows is None else rows
    shift = HASH_BITS - 4 * _digits(rows)
    label = stratum.cast("string") if stratum is not None else F.lit("")
    keyed = df.select(label.alias("stratum"), (hash_key(*key) if hashed is None else hashed).alias("h")).withColumn("prefix", F.shiftright("h", shift))
    counts = keyed.groupBy("stratum", "prefix").agg(F.count(F.lit(1)).alias("c"))
    running = Window.partitionBy("stratum").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
    ladder = (
        counts.withColumn("upto", F.sum("c").over(running))
        .withColumn("n", F.sum("c").over(Window.partitionBy("stratum")))
    )
    marks = F.array(*[F.struct(F.lit(name).alias("mark"), r.cast("bigint").alias("rank")) for name, r in ranks.items()])
    wanted = (
        ladder.withColumn("m", F.explode(marks))
        .select("stratum", "prefix", "n", "c", "upto", F.col("m.mark").alias("mark"), F.col("m.rank").alias("rank"))
    )
    steps = wanted.filter((F.col("rank") > F.col("upto") - F.col("c")) & (F.col("rank") <= F.col("upto"))).select(
        "stratum", "prefix", "mark", (F.col("rank") - F.col("upto") + F.col("c")).alias("place")
    )
    place = Window.partitionBy("stratum", "mark").orderBy("h")
    hits = (
        join_small(keyed, steps, ["stratum", "prefix"])
        .withColumn("at", F.row_number().over(place))
        .filter("at = place")
        .select("stratum", "mark", "h")
    )
    sizes = counts.groupBy("stratum").agg(F.sum("c").alias("n"))
    found = hits.groupBy("stratum").agg(
        *[F.max(F.when(F.col("mark") == name, F.col("h"))).alias(name) for name in ranks]
    )
    return sizes.join(found, "stratum", "left").select(
        "stratum", "n", *[F.coalesce(name, F.lit(-1)).alias(name) for name in ranks]
    )


def share_rank(permille: int) -> Column:
    """ceil(n · share) in whole-number arithmetic."""
    return F.floor((F.col("n") * permille + 999) / F.lit(1000))


def _with_cutoffs(df: DataFrame, key: list[str], stratum: str | None, ranks: dict[str, Column],
                  rows: int | None = None, hashed: Column | None = None) -> DataFrame:
    cuts = hash_cutoffs(df, key, column(stratum) if stratum else None, ranks, rows, hashed)
    cuts = cuts.select(F.col("stratum").alias("_stratum"), *[F.col(r).alias(f"_{r}") for r in ranks])
    marked = df.withColumns({
        "_stratum": column(stratum).cast("string") if stratum else F.lit(""),
        "_h": hash_key(*key) if hashed is None else hashed,
    })
    return join_small(marked, cuts, ["_stratum"], "left").drop("_stratum")


def strata_sizes(df: DataFrame, stratum: str) -> int:
    """Rows of the rarest class, 0 for none."""
    row = df.groupBy(column(stratum)).agg(F.count(F.lit(1)).alias("n")).agg(F.min("n").alias("least")).first()
    return row["least"] or 0


def random_split(df: DataFrame, key: list[str], permille: int = TEST_PERMILLE, stratify: str | None = None,
                 output: str = "is_test", rows: int | None = None) -> DataFrame:
    """Flag ceil(share · n) rows as test, per class when every class has two rows."""
    if stratify is not None and strata_sizes(df, stratify) < 2:
        stratify = None
    out = _with_cutoffs(df, key, stratify, {"cut": share_rank(permille)}, rows)
    return out.withColumn(output, F.col("_h") <= F.col("_cut")).drop("_h", "_cut")


def kfold_column(df: DataFrame, key: list[str], folds: int = FOLDS, stratify: str | None = None,
                 output: str = "fold", rows: int | None = None, hashed: Column | None = None) -> DataFrame:
    """A fold number 0..folds−1, fold sizes equal to within one row (per class)."""
    if stratify is not None and strata_sizes(df, stratify) < folds:
        stratify = None
    ranks = {f"cut{i}": F.floor((F.col("n") * i + folds - 1) / F.lit(folds)) for i in range(1, folds)}
    out = _with_cutoffs(df, key, stratify, ranks, rows, hashed)
    fold = sum((F.when(F.col("_h") > F.col(f"_{r}"), 1).otherwise(0) for r in ranks), F.lit(0))
    return out.withColumn(output, fold).drop("_h", *[f"_{r}" for r in ranks])


def training_flags(df: DataFrame, key: list[str], stratify: str | None, rows: int, folds: int = FOLDS, hashed: Column | None = None) -> DataFrame:
    """``_test``, ``_watch`` (early-stopping slice of the rest) and ``_fold`` in one pass when
    every class is large enough for all three."""
    least = strata_sizes(df, stratify) if stratify is not None else rows
    test = share_rank(TEST_PERMILLE)
    watch = test + F.floor(((F.col("n") - test) * VALIDATION_PERMILLE + 999) / F.lit(1000))
    parts = {"test": test, "watch": watch}
    cuts = {f"cut{i}": F.floor((F.col("n") * i + folds - 1) / F.lit(folds)) for i in range(1, folds)}
    together = least >= folds
    out = _with_cutoffs(df, key, stratify if least >= 2 else None, {**parts, **cuts} if together else parts, rows, hashed)
    out = out.withColumns({
        "_is_test": F.col("_h") <= F.col("_test"),
        "_is_watch": (F.col("_h") > F.col("_test")) & (F.col("_h") <= F.col("_watch")),
    }).drop("_test", "_watch").withColumnsRenamed({"_is_test": "_test", "_is_watch": "_watch"})
    if together:
        fold = sum((F.when(F.col("_h") > F.col(f"_{c}"), 1).otherwise(0) for c in cuts), F.lit(0))
        return out.withColumn("_fold", fold).drop("_h", *[f"_{c}" for c in cuts])
    return kfold_column(out.drop("_h"), key, folds, None, "_fold", rows, hashed)


def cap_rows(df: DataFrame, limit: int, key: list[str], time: str | None = None, rows: int | None = None) -> DataFrame:
    """At most ``limit`` rows: the most recent in time mode, else a random choice by key hash.

    This is an option of training, off unless asked for.
    """
    rows = df.count() if rows is None else rows
    if rows <= limit:
        return df
    if time is not None:
        terms = order_terms(df, time, key)
        points = cut_points(df, terms, [rows - limit], rows)
        return df.filter(~before_rank(terms, points, rows - limit, rows))
    out = _with_cutoffs(df, key, None, {"cut": F.lit(limit)}, rows)
    return out.filter("_h <= _cut").drop("_h", "_cut")


def time_ranks(rows: int, permille: int, gap: int) -> tuple[int, int]:
    """(end of training, start of test) positions of a chronological split."""
    cut = rows * (1000 - permille) // 1000
    return max(0, cut - gap), cut


def time_split(df: DataFrame, time: str, key: list[str], permille: int = TEST_PERMILLE, gap: int = 0,
               output: str = "part", rows: int | None = None) -> DataFrame:
    """``train``, ``gap`` (embargo rows) or ``test``: the test rows are the most recent."""
    rows = df.count() if rows is None else rows
    train_end, cut = time_ranks(rows, permille, gap)
    terms = order_terms(df, time, key)
    points = cut_points(df, terms, [train_end, cut], rows)
    part = (
        F.when(before_rank(terms, points, train_end, rows), "train")
        .when(before_rank(terms, points, cut, rows), "gap")
        .otherwise("test")
    )
    return df.withColumn(output, part)


def validation_slice(train: DataFrame, key: list[str], permille: int = VALIDATION_PERMILLE,
                     stratify: str | None = None, time: str | None = None, gap: int = 0,
                     output: str = "is_validation") -> DataFrame:
    """Mark the rows early stopping watches; embargo rows of time mode are dropped."""
    if time is None:
        return random_split(train, key, permille, stratify, output)
    marked = time_split(train, time, key, permille, gap, "_part")
    return marked.filter("_part <> 'gap'").withColumn(output, F.col("_part") == "test").drop("_part")


def fold_ranks(rows: int, folds: int = FOLDS, gap: int = 0) -> list[tuple[int, int, int]]:
    """(train end, test start, test end) of each expanding-window fold."""
    size = rows // (folds + 1)
    if size == 0 or rows - folds * size - gap <= 0:
        raise TabularError("TOO_FEW_ROWS", "Too few rows for walk-forward folds with that gap.")
    first = rows - folds * size
    return [(first + i * size - gap, first + i * size, first + (i + 1) * size) for i in range(folds)]


def walk_forward_conditions(df: DataFrame, time: str, key: list[str], folds: int = FOLDS, gap: int = 0,
                            rows: int | None = None) -> list[tuple[Column, Column]]:
    """(is training row, is test row) for each fold, as filters."""
    rows = df.count() if rows is None else rows
    plan = fold_ranks(rows, folds, gap)
    terms = order_terms(df, time, key)
    points = cut_points(df, terms, sorted({r for fold in plan for r in fold}), rows)

    def before(rank: int) -> Column:
        return before_rank(terms, points, rank, rows)

    return [(before(end), ~before(start) & before(stop)) for end, start, stop in plan]


def walk_forward_folds(df: DataFrame, time: str, key: list[str], folds: int = FOLDS, gap: int = 0) -> DataFrame:
    """Rows repeated per fold they take part in, with ``fold`` and ``role``."""
    roles = [
        F.struct(F.lit(i).alias("fold"), F.when(train, "train").when(test, "test").alias("role"))
        for i, (train, test) in enumerate(walk_forward_conditions(df, time, key, folds, gap))
    ]
    return (
        df.withColumn("_r", F.explode(F.array(*roles)))
        .filter("_r.role is not null")
        .select(*[column(c) for c in df.columns], "_r.fold", "_r.role")
    )
