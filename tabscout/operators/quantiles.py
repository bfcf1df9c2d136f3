"""Exact order statistics without sending a column through one task.

Spark's exact ``percentile`` keeps every distinct value of a column in one
aggregation buffer. It is used here only when the row count proves that buffer
small. Beyond that, each wanted rank is narrowed down by rounds of two map-side
aggregates: an approximate sketch proposes an interval around the rank and exact
counts confirm it, until the value is an endpoint or the open interval holds few
enough rows to order in one place.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.functions.scalars import column

SMALL_ROWS = 100_000  # rows an exact percentile buffer may hold per column
SETTLE_ROWS = 100_000  # rows one narrowed interval may hold
CELLS_PER_JOB = 1_600_000  # values buffered by one aggregate over several columns
HUNTS_PER_JOB = 60
SKETCH_ACCURACY = 10_000


@dataclass
class _Hunt:
    """One wanted rank (0-based among non-null values) and what is known about it."""

    name: str
    rank: int
    low: object = None  # open bounds of the interval still searched
    high: object = None
    below: int = 0  # rows at or under ``low``
    inside: int = 0  # rows strictly between the bounds
    value: object = None
    found: bool = False

    def within(self, c: Column) -> Column:
        test = c.isNotNull()
        if self.low is not None:
            test = test & (c > F.lit(self.low))
        if self.high is not None:
            test = test & (c < F.lit(self.high))
        return test


def order_statistics(df: DataFrame, wanted: dict[str, list[int]], counts: dict[str, int] | None = None,
                     settle_rows: int = SETTLE_ROWS) -> dict[str, dict[int, object]]:
    """The exact values at 0-based ranks of each column's non-null values.

    ``wanted`` maps a column name to ranks. Returns ``{column: {rank: value}}``.
    Columns must be numeric; callers pass timestamps as microseconds.
    """
    wanted = {name: sorted(set(ranks)) for name, ranks in wanted.items() if ranks}
    if not wanted:
        return {}
    if counts is None:
        counts = non_null_counts(df, list(wanted))
    hunts = [
        _Hunt(name, rank, inside=counts[name])
        for name, ranks in wanted.items()
        for rank in ranks
        if 0 <= rank < counts[name]
    ]
    pending = hunts
    while pending:
        ready = [h for h in pending if h.inside <= settle_rows]
        width = _batch_width([h.inside for h in ready])
        for start in range(0, len(ready), width):
            _settle(df, ready[start:start + width])
        wide = [h for h in pending if not h.found]
        for start in range(0, len(wide), HUNTS_PER_JOB):
            _narrow(df, wide[start:start + HUNTS_PER_JOB])
        pending = [h for h in wide if not h.found]
    result: dict[str, dict[int, object]] = {name: {} for name in wanted}
    for hunt in hunts:
        result[hunt.name][hunt.rank] = hunt.value
    return result


def _batch_width(rows: list[int]) -> int:
    """How many buffers of these sizes one aggregate may hold together."""
    largest = max([1, *rows])
    return max(1, min(HUNTS_PER_JOB, CELLS_PER_JOB // largest))


def _settle(df: DataFrame, hunts: list[_Hunt]) -> None:
    """Read ranks out of intervals already known to hold few rows."""
    exprs = []
    for i, hunt in enumerate(hunts):
        c = column(hunt.name)
        ordered = F.sort_array(F.collect_list(F.when(hunt.within(c), c)))
        exprs.append(F.element_at(ordered, hunt.rank - hunt.below + 1).alias(f"v{i}"))
    row = df.agg(*exprs).first()
    for i, hunt in enumerate(hunts):
        hunt.value, hunt.found = row[f"v{i}"], True


def _narrow(df: DataFrame, hunts: list[_Hunt]) -> None:
    """One round: sketch each interval, then count exactly around the proposals.

    Ranks searched in the same interval share one sketch, and equal proposals one count.
    """
    reach = 2.0 / SKETCH_ACCURACY
    shared: dict[tuple, list[_Hunt]] = {}
    for hunt in hunts:
        shared.setdefault((hunt.name, hunt.low, hunt.high), []).append(hunt)
    sketches = []
    for i, members in enumerate(shared.values()):
        c = column(members[0].name)
        shares = [(h.rank - h.below) / max(h.inside - 1, 1) for h in members]
        marks = [m for s in shares for m in (max(s - reach, 0.0), min(s + reach, 1.0))]
        sketches.append(
            F.percentile_approx(F.when(members[0].within(c), c), marks, SKETCH_ACCURACY).alias(f"p{i}")
        )
    found = df.agg(*sketches).first()
    proposals: dict[int, list] = {}
    for i, members in enumerate(shared.values()):
        for j, hunt in enumerate(members):
            proposals[id(hunt)] = found[f"p{i}"][2 * j:2 * j + 2]
    wanted = sorted({(h.name, mark) for h in hunts for mark in proposals[id(h)]})
    checks = []
    for i, (name, mark) in enumerate(wanted):
        c = column(name)
        checks += [F.count_if(c < F.lit(mark)).alias(f"lt{i}"), F.count_if(c <= F.lit(mark)).alias(f"le{i}")]
    tally = df.agg(*checks).first()
    place = {key: i for i, key in enumerate(wanted)}
    for hunt in hunts:
        top = hunt.below + hunt.inside
        for mark in proposals[id(hunt)]:
            i = place[hunt.name, mark]
            under, upto = tally[f"lt{i}"], tally[f"le{i}"]
            if under <= hunt.rank < upto:
                hunt.value, hunt.found = mark, True
                break
            if hunt.below <= upto <= hunt.rank:
                hunt.low, hunt.below = mark, upto
            elif hunt.rank < under <= top:
                hunt.high, top = mark, under
        hunt.inside = top - hunt.below


def non_null_counts(df: DataFrame, names: list[str]) -> dict[str, int]:
    row = df.agg(*[F.count(column(n)).alias(f"c{i}") for i, n in enumerate(names)]).first()
    return {n: row[f"c{i}"] for i, n in enumerate(names)}


def exact_quantiles(df: DataFrame, names: list[str], shares: list[float],
                    counts: dict[str, int] | None = None,
                    small_rows: int = SMALL_ROWS) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of numeric columns, exact at any size."""
    if not names:
        return {}
    if counts is None:
        counts = non_null_counts(df, names)
    result: dict[str, list[float | None]] = {}
    small = [n for n in names if counts[n] <= small_rows]
    width = _batch_width([counts[n] for n in small])
    for start in range(0, len(small), width):
        batch = small[start:start + width]
        row = df.agg(
            *[F.percentile(column(n), F.array(*[F.lit(s) for s in shares])).alias(f"q{i}") for i, n in enumerate(batch)]
        ).first()
        for i, n in enumerate(batch):
            result[n] = list(row[f"q{i}"]) if row[f"q{i}"] is not None else [None] * len(shares)
    large = [n for n in names if counts[n] > small_rows]
    ranks = {
        n: [r for s in shares for r in (math.floor(s * (counts[n] - 1)), math.ceil(s * (counts[n] - 1)))]
        for n in large
    }
    found = order_statistics(df, ranks, counts, min(small_rows, SETTLE_ROWS))
    for n in large:
        values = []
        for s in shares:
            place = s * (counts[n] - 1)
            low, high = float(found[n][math.floor(place)]), float(found[n][math.ceil(place)])
            values.append(low + (high - low) * (place - math.floor(place)))
        result[n] = values
    return result
