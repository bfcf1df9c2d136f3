"""Row order at any size: balanced range buckets, look-back windows, rank cut points.

A window over one long series would run as one task. Rows are instead assigned to
range buckets by a short table of bounds, each bucket runs its own window, and only the few rows
at bucket edges are recomputed together. A row's *position* is never materialised for
splits: the ordering values at the wanted ranks are found by aggregates and the split
becomes a plain filter.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabscout.functions.scalars import as_time, column, dtype_of, is_integral, is_number, is_time
from tabscout.operators.quantiles import order_statistics

ROWS_PER_BUCKET = 1_000_000
# Sampled order tuples per bucket, and in all; with fewer per bucket, buckets are less even, never fewer.
SAMPLE_PER_BUCKET, SAMPLE = 64, 1 << 20
LOWEST = -(2.0**62)


def order_terms(df: DataFrame, time: str | None, key: list[str]) -> list[Column]:
    """Numeric sort terms: the time in microseconds, then the key columns.

    Text keys stand in as the first 52 bits of their MD5, which only breaks ties.
    """
    terms = [F.unix_micros(as_time(df, time))] if time else []
    for name in key:
        dtype = dtype_of(df, name)
        if is_time(dtype):
            term = F.unix_micros(column(name).cast("timestamp"))
        elif is_number(dtype):
            term = column(name)
        else:
            term = F.conv(F.substring(F.md5(column(name).cast("string")), 1, 13), 16, 10).cast("bigint")
        terms.append(F.coalesce(term, F.lit(LOWEST).cast(dtype if is_number(dtype) else T.LongType())))
    return terms


def _tuple_less(left: list[Column], right: list) -> Column:
    """Lexicographic ``left < right`` against literals (NULL sorts first)."""
    result = F.lit(False)
    for c, v in reversed(list(zip(left, right))):
        if v is None:
            result = F.when(c.isNull(), result).otherwise(False)
        else:
            smaller = c.isNull() | (c < F.lit(v))
            result = F.when(smaller, True).when(c == F.lit(v), result).otherwise(False)
    return result


def with_buckets(df: DataFrame, terms: list[Column], rows: int, per_bucket: int = ROWS_PER_BUCKET,
                 seed: int = 42) -> tuple[DataFrame, list[Column], int]:
    """Add ``_bucket``, a number that follows the order of ``terms``, and the terms as columns.

    Returns the table, the term columns and the number of bounds. There are as many buckets
    as ``rows / per_bucket`` asks for. Bounds are whole tuples from a bounded sample, so equal
    leading values can still be split by the later terms. They only steer balance: any bounds
    give a correct order. A row's bucket is the number of bounds at or below it, searched in batches
    by one function whatever the number of bounds; no plan grows with them and no row carries them.
    """
    named = df.withColumns({f"_o{i}": _orderable(df, t) for i, t in enumerate(terms)})
    order = [F.col(f"_o{i}") for i in range(len(terms))]
    wanted = -(-rows // per_bucket)
    if wanted <= 1:
        return named.withColumn("_bucket", F.lit(0)), order, 0
    share = min(1.0, min(wanted * SAMPLE_PER_BUCKET, SAMPLE) / rows)
    slim = named.select(*order)
    ladder, bounds = _ladder((slim if share >= 1.0 else slim.sample(share, seed)).toArrow(), wanted)
    if not bounds:
        return named.withColumn("_bucket", F.lit(0)), order, 0

    @F.arrow_udf("int")
    def bucket(*columns: pa.Array) -> pa.Array:
        return pa.array(_reached(columns, ladder), pa.int32())

    return named.withColumn("_bucket", bucket(*order)), order, bounds


def _ladder(sample: pa.Table, wanted: int) -> tuple[list[tuple], int]:
    """Bounds of buckets of about equal shares of the sample, by term, and their number.

    Of each term: its distinct values in the bounds, the codes of the bounds' beginnings up to this term, each once, and how
    many bounds lie before each of them.
    """
    if not sample.num_rows:
        return [], 0
    columns = [c.combine_chunks() for c in sample.columns]
    places = [_place(c, np.unique(_known(c))) for c in columns]
    picked = np.lexsort(places[::-1])[[sample.num_rows * i // wanted for i in range(1, wanted)]]
    ties = np.logical_and.reduce([p[picked[1:]] == p[picked[:-1]] for p in places])
    picked = picked[np.append(True, ~ties)]
    ladder, begun = [], np.zeros(len(picked), dtype=np.int64)
    for c in columns:
        own = c.take(pa.array(picked))
        marks = np.unique(_known(own))
        codes, first, begun = np.unique(begun * _width(marks) + _place(own, marks), return_index=True, return_inverse=True)
        ladder.append((marks, codes, np.append(first, len(picked))))
    return ladder, len(picked)


def _reached(columns: Sequence[pa.Array], ladder: list[tuple]) -> np.ndarray:
    """How many bounds are at or below each row. Only rows that tie with a bound so far look at the next term."""
    out = np.zeros(len(columns[0]), dtype=np.int64)
    left, begun = np.arange(len(out)), np.zeros(len(out), dtype=np.int64)
    for level, (column_, (marks, codes, first)) in enumerate(zip(columns, ladder)):
        own = column_ if len(left) == len(column_) else column_.take(pa.array(left))
        wanted = begun * _width(marks) + _place(own, marks)
        at = np.searchsorted(codes, wanted)
        tied = codes[np.minimum(at, len(codes) - 1)] == wanted
        out[left] = first[at] + (tied if level == len(ladder) - 1 else 0)
        left, begun = left[tied], at[tied]
        if not len(left):
            break
    return out


def _known(values: pa.Array) -> np.ndarray:
    return values.drop_null().to_numpy(zero_copy_only=False)


def _width(marks: np.ndarray) -> int:
    return 2 * len(marks) + 2


def _place(values: pa.Array, marks: np.ndarray) -> np.ndarray:
    """Where values lie among sorted marks, nulls first: even numbers from 2 on a mark, odd ones between."""
    out = np.zeros(len(values), dtype=np.int64)
    known = _known(values)
    at = np.searchsorted(marks, known)
    there = marks[np.minimum(at, len(marks) - 1)] if len(marks) else known
    same = (there == known) | ((there != there) & (known != known))
    out[values.is_valid().to_numpy(zero_copy_only=False)] = 1 + 2 * at + (same if len(marks) else 0)
    return out


def _orderable(df: DataFrame, term: Column) -> Column:
    """The term as bigint, double or text, so that bounds can be written as literals."""
    dtype = df.select(term).schema[0].dataType
    if is_integral(dtype):
        return term.cast("bigint")
    return term.cast("double") if is_number(dtype) else term.cast("string")


def look_back(df: DataFrame, order: list[Column], series: list[str], build: Callable, reach: int,
              rows: int | None = None, per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add columns computed from at most ``reach`` earlier rows of the same series.

    ``build(window)`` returns ``{name: Column}``. One shuffle by bucket; rows within
    ``reach`` of a bucket edge are gathered (a few per bucket) and computed again with
    their true neighbours.
    """
    rows = df.count() if rows is None else rows
    keys = [column(s) for s in series]
    keyed, terms, bounds = with_buckets(df, keys + order, rows, per_bucket)
    given, order = order, terms[len(keys):]
    helpers = ["_bucket", "_at", "_size", "_first", "_last", *[f"_o{i}" for i in range(len(terms))]]
    if not bounds:
        window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)
        return keyed.withColumns(build(window)).drop(*helpers)
    # Buckets follow the series, so only a bucket's first and last series can go on in another bucket.
    own, whole = F.struct(*[t.alias(f"k{i}") for i, t in enumerate(terms[: len(keys)])]) if keys else F.lit(0), Window.partitionBy("_bucket")
    keyed = keyed.withColumns({"_first": F.min(own).over(whole), "_last": F.max(own).over(whole)})
    group = Window.partitionBy("_bucket", *keys)
    local = group.orderBy(*order)
    body = keyed.withColumns(
        {**build(local), "_at": F.row_number().over(local), "_size": F.count(F.lit(1)).over(group)}
    )
    made = [c for c in body.columns if c not in keyed.columns and c not in ("_at", "_size")]
    split = own.eqNullSafe(F.col("_first")) | own.eqNullSafe(F.col("_last"))
    head = split & (F.col("_at") <= reach)
    edges = body.filter(split & ((F.col("_at") <= reach) | (F.col("_size") - F.col("_at") < reach)))
    mark = "_head"
    while mark in df.columns:  # edges of edges
        mark += "_"
    edges = edges.withColumn(mark, head).drop(*made, *helpers)
    # A few rows per bucket; should they be many themselves, they go to buckets again.
    few = max(per_bucket, 16 * reach)
    at_edges = min(rows, 4 * reach * (bounds + 1))
    if at_edges > few and at_edges < rows:
        mended = look_back(edges, given, series, build, reach, at_edges, few)
    else:
        joined = Window.partitionBy(*([column(s) for s in series] or [F.lit(0)])).orderBy(*given)
        mended = edges.withColumns(build(joined))
    mended = mended.filter(F.col(mark)).drop(mark)
    return body.filter(~head).drop(*helpers).unionByName(mended.drop(*helpers))


def global_position(df: DataFrame, order: list[Column], output: str = "position", rows: int | None = None,
                    per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Each row's 1-based place in the whole order: place in its bucket plus earlier buckets."""
    rows = df.count() if rows is None else rows
    keyed, terms, bounds = with_buckets(df, order, rows, per_bucket)
    local = Window.partitionBy("_bucket").orderBy(*terms)
    placed = keyed.withColumn("_at", F.row_number().over(local))
    if bounds:
        # One row per bucket, so their running total is one small window.
        sizes = keyed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_size"))
        running = Window.partitionBy(F.lit(0)).orderBy("_bucket")
        starts = sizes.select("_bucket", (F.sum("_size").over(running) - F.col("_size")).alias("_start"))
        placed = placed.join(F.broadcast(starts), "_bucket")
    else:
        placed = placed.withColumn("_start", F.lit(0))
    names = [c for c in df.columns if c != output]
    return placed.select(*[column(c) for c in names], (F.col("_start") + F.col("_at")).cast("bigint").alias(output))


def cut_points(df: DataFrame, terms: list[Column], ranks: list[int], rows: int) -> dict[int, tuple | None]:
    """The order tuple found at each 0-based rank; rows before it sort strictly lower.

    Levels after the first are only looked at among rows that tie so far. Ranks at or
    beyond the ends map to ``None`` (start) or are absent (end).
    """
    named = df.select(*[t.alias(f"t{i}") for i, t in enumerate(terms)])
    inner = sorted({r for r in ranks if 0 < r < rows})
    result: dict[int, tuple | None] = {r: None for r in ranks if r <= 0}
    if not inner:
        return result

    def descend(table: DataFrame, level: int, size: int, places: dict[int, int], prefix: tuple) -> None:
        name = f"t{level}"
        values = order_statistics(table, {name: sorted(set(places.values()))}, {name: size})[name]
        if level == len(terms) - 1:
            for rank, place in places.items():
                result[rank] = (*prefix, values[place])
            return
        grouped: dict[object, dict[int, int]] = {}
        for rank, place in places.items():
            grouped.setdefault(values[place], {})[rank] = place
        c = F.col(name)
        tally = table.agg(
            *[e for i, v in enumerate(grouped) for e in
              (F.count_if(c < F.lit(v)).alias(f"b{i}"), F.count_if(c == F.lit(v)).alias(f"e{i}"))]
        ).first()
        for i, (value, members) in enumerate(grouped.items()):
            ties = tally[f"e{i}"]
            inside = {rank: place - tally[f"b{i}"] for rank, place in members.items()}
            if ties == 1:
                for rank in inside:
                    result[rank] = (*prefix, value)
            else:
                descend(table.filter(c == F.lit(value)), level + 1, ties, inside, (*prefix, value))

    descend(named, 0, rows, {r: r for r in inner}, ())
    return result


def before_rank(terms: list[Column], points: dict[int, tuple | None], rank: int, rows: int) -> Column:
    """True for the rows whose position in the order is below ``rank``."""
    if rank >= rows:
        return F.lit(True)
    point = points.get(rank)
    if point is None:
        return F.lit(False)
    return _tuple_less(terms[: len(point)], list(point))
