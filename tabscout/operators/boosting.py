"""Gradient-boosted trees grown from histograms, many models in the same passes over the data.

Rows are packed once into blocks of one-byte bin codes and stay where they are. Rows of a partition with equal codes are in one
cell: trees can't tell them apart, so they share a margin. Once a round the rows' gradients and hessians are added up by cell;
the jobs of the levels read cells only. For each level one job adds them up by (model, class, node, feature, bin). The sums of a
node meet in one reducer, which returns only the best split, so the driver gets a split per open node whatever the rows, features
or bins. Sums that are small, counted over all partitions, are added up in the driver instead, which saves the shuffle. The job of
the first level also adds the last trees to the cells' margins and sums the watched losses. Folds, trials,
classes and quantiles are further keys of the same sums: they cost no pass of their own.

A plan whose sums follow from the number and mean of rows with equal codes and roles (and equal class) reads such rows merged; if
all do, no single row is read after the first job. Quantiles and samples of rows read them one by one, once or twice a round.

Where the cells of all partitions are few, by number and beside the rows, the driver keeps their margins, and every level is read
off sums by cell over all partitions. For plans that read rows merged the driver holds the merged rows of all partitions too, if
those are few: their rounds are no job at all, whatever the rows. For the others one job a round adds up gradients and hessians by
cell, two with quantiles, whatever the depth; their rows are stored once, and only margins by cell travel.

A missing value has a bin of its own and is tried on both sides of each split. Categories are ordered by gradient over hessian
within the node and split as sets. Rules of direction bound the weights of both sides while the tree grows. Margins can be
computed again from the trees at any time; they are, every REBUILD rounds, so a lost executor costs a bounded recomputation.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import RDD, Broadcast, StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabscout.operators.trees import Forest, Tree

PATIENCE = 25
BLOCK_ROWS = 65_536
REBUILD = 16
REDUCER_NODES = 16  # nodes whose splits one reducer finds
COLLECTED = 32 << 20  # bytes of all partitions' sums up to which they are added up without a shuffle
MERGED_BYTES = 44  # of a merged row
CELL_ROWS = 4  # rows to a cell of all partitions from which on levels are read off the cells' sums
RARE = 8  # possible codes for each row from which on equal ones aren't looked for
SEARCHED = 1 << 22  # sums looked at together
SUMMARY = 512  # points of a leaf's summary of residuals
LEAST_GAIN = 1e-6
SAME_GAIN = 1e-9  # gains this close, as a share, are equal; the first split wins
LEAST_HESSIAN = 1e-16


@dataclass(frozen=True)
class Params:
    """What a boosted ensemble is grown with."""

    max_depth: int = 6
    learning_rate: float = 0.05
    n_estimators: int = 500
    subsample: float = 1.0
    colsample: float = 1.0
    min_child: float = 1.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    max_bins: int = 64


# ---------------------------------------------------------------- bins


@dataclass(frozen=True)
class Bins:
    """Codes of feature values: per slot the upper ends of its bins, or None for categories. The last code is a missing value."""

    edges: tuple[np.ndarray | None, ...]
    categories: tuple[int, ...]

    @property
    def width(self) -> int:
        return 1 + max([2, *(c if e is None else len(e) + 1 for e, c in zip(self.edges, self.categories))])

    @property
    def taken(self) -> np.ndarray:
        """slots × codes: which codes a slot has."""
        sizes = [c if e is None else len(e) + 1 for e, c in zip(self.edges, self.categories)]
        return (np.arange(self.width) < np.array(sizes, dtype=int)[:, None]) | (np.arange(self.width) == self.width - 1)

    def codes(self, x: np.ndarray) -> np.ndarray:
        """rows × slots of values become slots × rows of codes."""
        out = np.empty((x.shape[1], len(x)), dtype=np.uint8)
        for slot, edges in enumerate(self.edges):
            values = x[:, slot]
            known = ~np.isnan(values)
            found = np.searchsorted(edges, values) if edges is not None else np.where(known, values, 0)
            out[slot] = np.where(known, found, self.width - 1)
        return out


def learn_bins(encoded: DataFrame, categories: list[int], max_bins: int) -> Bins:
    """Bins of about equal counts from quantile sketches of all slots, in one aggregate. categories: the number of a slot's
    categories, 0 for numbers."""
    x = vector_to_array("features")
    shares = [float(k) / max_bins for k in range(1, max_bins)]
    numbers = [i for i, c in enumerate(categories) if not c]
    marks = [F.percentile_approx(F.when(~F.isnan(x[i]), x[i]), shares, 10_000).alias(f"_{i}") for i in numbers]
    ends = [F.max(F.when(~F.isnan(x[i]), x[i])).alias(f"_top{i}") for i in numbers]
    row = encoded.agg(*marks, *ends).first() if numbers else {}
    edges: list[np.ndarray | None] = []
    for i, c in enumerate(categories):
        found = np.unique(np.array(row[f"_{i}"] or [], dtype=float)) if not c else None
        # Nothing lies above the largest value, so it ends no bin.
        edges.append(found if found is None else found[found < row[f"_top{i}"]] if len(found) else found)
    return Bins(tuple(edges), tuple(categories))


# ---------------------------------------------------------------- plans


@dataclass(frozen=True)
class Plan:
    """One model to grow: what it learns from, how, and when it ends."""

    params: Params
    objective: str  # squared, logistic, softmax or quantile
    rows: int  # bit of the rows it learns from
    watched: int | None = None  # bit of the rows whose loss ends it
    classes: int = 1  # margins of a row
    share: float = 0.5  # of the quantile
    weighted: bool = False
    rules: dict[int, int] = field(default_factory=dict)  # slot -> 1 rises, -1 falls
    leader: int | None = None  # plan whose number of rounds it takes over
    seed: int = 42
    start: tuple[float, ...] = (0.0,)

    @property
    def by_row(self) -> bool:
        """Whether merged rows don't tell its sums."""
        return self.objective == "quantile" or self.params.subsample < 1 or self.weighted and self.objective == "squared"

    def gradients(self, margin: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivative of the loss, classes × rows."""
        if self.objective == "squared":
            return margin - y, np.ones_like(margin)
        if self.objective == "quantile":
            return np.where(y < margin, 1 - self.share, -self.share), np.ones_like(margin)
        p = self.chances(margin)
        if self.objective == "logistic":
            return p - y, np.maximum(p * (1 - p), LEAST_HESSIAN)
        return p - (y == np.arange(len(p))[:, None]), np.maximum(2 * p * (1 - p), LEAST_HESSIAN)

    def chances(self, margin: np.ndarray) -> np.ndarray:
        if self.objective == "logistic":
            return 1 / (1 + np.exp(-margin))
        e = np.exp(margin - margin.max(axis=0))
        return e / e.sum(axis=0)

    def losses(self, margin: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.objective == "squared":
            return (margin[0] - y) ** 2
        if self.objective == "quantile":
            apart = y - margin[0]
            return np.maximum(self.share * apart, (self.share - 1) * apart)
        p = self.chances(margin)
        p = np.where(y == 1, p[0], 1 - p[0]) if self.objective == "logistic" else p[y.astype(int), np.arange(len(y))]
        return -np.log(np.maximum(p, 1e-15))

    def mean_loss(self, total: float, rows: float) -> float:
        return math.sqrt(total / rows) if self.objective == "squared" else float(total / rows)


@dataclass
class Fit:
    """The trees of one model so far, and its watched loss after each round."""

    plan: Plan
    rounds: list[list[Growing]] = field(default_factory=list)
    losses: list[float] = field(default_factory=list)

    @property
    def best(self) -> int:
        """Rounds up to the least watched loss, or all."""
        return int(np.argmin(self.losses)) + 1 if self.losses else len(self.rounds)

    @property
    def least_loss(self) -> float:
        return min(self.losses, default=math.nan)

    def ended(self, patience: int) -> bool:
        return len(self.rounds) >= self.plan.params.n_estimators or bool(self.losses) and len(self.losses) - self.best >= patience

    def cut(self, rounds: int) -> Fit:
        return Fit(self.plan, self.rounds[:rounds], self.losses[:rounds])

    def forest(self, bins: Bins) -> Forest:
        trees = [t.tree(bins, k, self.plan.classes) for trees in self.rounds for k, t in enumerate(trees)]
        return Forest(trees, [1.0] * len(trees), len(bins.edges), np.array(self.plan.start, dtype=float))


@dataclass(frozen=True)
class Paths:
    """A tree as arrays that place rows of codes: `table[node, code]` tells the side."""

    slot: np.ndarray
    left: np.ndarray
    right: np.ndarray
    table: np.ndarray
    value: np.ndarray
    open: tuple[int, ...]
    depth: int

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The node of each row."""
        size, width = codes.shape[1], self.table.shape[1]
        if not self.depth:
            return np.zeros(size, dtype=np.int64)
        # The next node by node and code, an end being its own; flat, as that is several times faster to look up.
        sides = np.where(self.table, self.left[:, None], self.right[:, None])
        follow = np.where(self.left[:, None] >= 0, sides, np.arange(len(self.slot))[:, None]).ravel()
        at = follow.take(codes[self.slot[0]])
        if self.depth > 1:
            flat, begin, rows = codes.ravel(), self.slot * size, np.arange(size)
            for _ in range(self.depth - 1):
                at = follow.take(at * width + flat.take(begin.take(at) + rows))
        return at

    def margin(self, codes: np.ndarray) -> np.ndarray:
        return self.value[self.place(codes)]


class Growing:
    """A tree over bin codes. Nodes without children are ends; the open ones may still be split."""

    def __init__(self, bins: Bins):
        self.width, self.depth = bins.width, 0
        self.slot, self.left, self.right = [-1], [-1], [-1]
        self.left_of: list[np.ndarray | None] = [None]
        self.missing_left, self.gain, self.cover, self.value = [False], [0.0], [0.0], [0.0]
        self.bounds = [(-math.inf, math.inf)]
        self.open = [0]
        self.paths: Paths | None = None

    def split(self, node: int, s: Split, rule: int) -> None:
        low, high = self.bounds[node]
        middle = (s.weights[0] + s.weights[1]) / 2
        sides = [(low, high), (low, high)] if not rule else [(low, middle), (middle, high)] if rule > 0 else [(middle, high), (low, middle)]
        self.slot[node], self.left_of[node], self.missing_left[node], self.gain[node] = s.slot, s.left_of, s.missing_left, s.gain
        self.left[node], self.right[node] = len(self.slot), len(self.slot) + 1
        for weight, cover, bounds in zip(s.weights, s.covers, sides):
            for values, v in ((self.slot, -1), (self.left, -1), (self.right, -1), (self.left_of, None), (self.missing_left, False), (self.gain, 0.0),
                              (self.cover, cover), (self.value, weight), (self.bounds, bounds)):
                values.append(v)

    def pack(self) -> None:
        table = np.zeros((len(self.slot), self.width), dtype=bool)
        for node, sides in enumerate(self.left_of):
            if sides is not None:
                table[node] = sides
        self.paths = Paths(np.maximum(self.slot, 0), np.array(self.left), np.array(self.right), table, np.array(self.value), tuple(self.open), self.depth)

    def tree(self, bins: Bins, k: int, classes: int) -> Tree:
        """The tree over feature values; its output is number k of so many."""
        threshold, sets = np.zeros(len(self.slot)), {}
        for node, slot in enumerate(self.slot):
            if slot < 0:
                continue
            inside = np.nonzero(self.left_of[node][:-1])[0]
            if bins.edges[slot] is None:
                sets[node] = inside[inside < bins.categories[slot]].astype(float)
            else:
                threshold[node] = np.append(bins.edges[slot], np.inf)[min(inside[-1], len(bins.edges[slot]))]
        value = np.zeros((len(self.slot), classes))
        value[:, k] = self.value
        return Tree(np.array(self.slot), threshold, np.array(self.left), np.array(self.right), np.array(self.cover, dtype=float), value, sets,
                    np.array(self.missing_left), np.array(self.gain))


# ---------------------------------------------------------------- splits


@dataclass(frozen=True)
class Split:
    gain: float
    slot: int
    left_of: np.ndarray
    missing_left: bool
    weights: tuple[float, float]
    covers: tuple[float, float]


@dataclass(frozen=True)
class Search:
    """How the best splits of nodes are found from their sums."""

    params: Params
    bins: Bins
    slots: tuple[int, ...]
    rules: dict[int, int]

    def weight(self, g: np.ndarray, h: np.ndarray, bounds: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        pulled = np.sign(g) * np.maximum(np.abs(g) - self.params.reg_alpha, 0)
        below = h + self.params.reg_lambda
        return np.clip(np.divide(-pulled, below, out=np.zeros_like(pulled, dtype=float), where=below > 0), *bounds)

    def score(self, g: np.ndarray, h: np.ndarray, w: np.ndarray) -> np.ndarray:
        """How much a weight lowers the penalised loss, twice."""
        return -(2 * g * w + (h + self.params.reg_lambda) * w * w + 2 * self.params.reg_alpha * np.abs(w))

    def best(self, sums: np.ndarray, bounds: np.ndarray) -> list[tuple[float, float, Split | None]]:
        """(weight, cover, best split) of each node. sums: nodes × 2 × slots × codes, the last code missing; bounds: nodes × 2."""
        step = max(1, SEARCHED // sums[0].size)
        return [found for k in range(0, len(sums), step) for found in self._best(sums[k : k + step], bounds[k : k + step])]

    def _best(self, sums: np.ndarray, bounds: np.ndarray) -> list[tuple[float, float, Split | None]]:
        total = sums[:, :, 0].sum(axis=2)
        known, missing = sums[:, :, self.slots, :-1], sums[:, :, self.slots, -1]
        # Numbers in order of their bins, categories by gradient over hessian, those without rows last.
        kinds = [self.bins.edges[s] is None for s in self.slots]
        order = np.broadcast_to(np.arange(known.shape[3]), (len(sums), *known.shape[2:])).copy()
        if any(kinds):
            g, h = known[:, 0, kinds], known[:, 1, kinds]
            order[:, kinds] = np.argsort(np.where(h > 0, g / (h + self.params.reg_lambda + LEAST_HESSIAN), np.inf), axis=2, kind="stable")
        upto = np.cumsum(np.take_along_axis(known, order[:, None], axis=3), axis=3)
        # nodes × (missing to the right, to the left) × slots × bins
        g1, h1 = (np.stack([upto[:, i], upto[:, i] + missing[:, i, :, None]], axis=1) for i in (0, 1))
        g, h = total[:, 0, None, None, None], total[:, 1, None, None, None]
        limits = (bounds[:, 0, None, None, None], bounds[:, 1, None, None, None])
        w1, w2, whole = self.weight(g1, h1, limits), self.weight(g - g1, h - h1, limits), self.weight(g, h, limits)
        gain = self.score(g1, h1, w1) + self.score(g - g1, h - h1, w2) - self.score(g, h, whole)
        least = max(self.params.min_child, LEAST_GAIN)
        rule = np.array([self.rules.get(s, 0) for s in self.slots])[:, None]
        allowed = (h1 >= least) & (h - h1 >= least) & ((w2 - w1) * rule >= 0)
        # Without missing rows both sides are the same split.
        allowed[:, 1] &= missing[:, 1, :, None] > 0
        flat = np.where(allowed, gain, -np.inf).reshape(len(sums), -1)
        top = flat.max(axis=1)
        first = (flat >= (top * (1 - SAME_GAIN))[:, None]).argmax(axis=1)
        out = []
        for n, (at, most) in enumerate(zip(first.tolist(), top.tolist())):
            split = None
            if most > LEAST_GAIN:
                side, place, k = np.unravel_index(at, gain.shape[1:])
                left = float(h1[n, side, place, k])
                right = float(total[n, 1]) - left
                left_of = np.zeros(self.bins.width, dtype=bool)
                left_of[order[n, place, : k + 1]] = True
                # Where nothing is missing, a missing value goes with most rows.
                left_of[-1] = bool(side) if missing[n, 1, place] > 0 else left >= right
                weights = (float(w1[n, side, place, k]), float(w2[n, side, place, k]))
                split = Split(float(gain[n, side, place, k]), self.slots[place], left_of, bool(left_of[-1]), weights, (left, right))
            out.append((float(whole[n, 0, 0, 0]), float(total[n, 1]), split))
        return out


# ---------------------------------------------------------------- blocks


@dataclass
class Block:
    codes: np.ndarray  # slots × rows
    label: np.ndarray
    weight: np.ndarray | None  # None while growing plans without weights
    roles: np.ndarray  # bits of the plans' rows
    key: np.ndarray | None  # None while growing plans that draw no samples
    margins: list[np.ndarray] = field(default_factory=list)  # per plan classes × rows


def blocks_of(encoded: DataFrame, bins: Bins, roles: list[Column], weight: Column, key: Column) -> RDD:
    """The table as blocks of codes. roles: which rows belong to bit 0, 1, …; key: a number that draws samples."""
    bits = F.lit(0).cast("long")
    for k, role in enumerate(roles):
        bits = bits.bitwiseOR(F.when(role, F.lit(1 << k)).otherwise(0).cast("long"))
    rows = encoded.select(vector_to_array("features").alias("x"), F.col("label").cast("double"), weight.cast("double").alias("w"), bits.alias("roles"), key.alias("key"))
    size = len(bins.edges)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def block() -> pa.RecordBatch:
            parts = [np.concatenate(p, axis=-1) for p in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["codes", "label", "weight", "roles", "key"])

        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(0).flatten()).reshape(-1, size)
            held.append([bins.codes(x), *(np.asarray(batch.column(k)) for k in range(1, 5))])
            if sum(h[0].shape[1] for h in held) >= BLOCK_ROWS:
                yield block()
                held = []
        if held:
            yield block()

    packed = rows.mapInArrow(pack, "codes binary, label binary, weight binary, roles binary, key binary")

    def unpacked(r) -> Block:
        return Block(np.frombuffer(bytes(r.codes), dtype=np.uint8).reshape(size, -1), np.frombuffer(bytes(r.label)), np.frombuffer(bytes(r.weight)),
                     np.frombuffer(bytes(r.roles), dtype=np.int64), np.frombuffer(bytes(r.key), dtype=np.int64))

    return packed.rdd.map(unpacked)


def started(plans: list[Plan], fits: list[Fit]) -> Callable[[Block], Block]:
    """Margins from the plans' starts and all trees so far. Of the rest only what the plans look at goes along, as each job
    hands all of it to Python again."""
    starts, rounds = [p.start for p in plans], [[paths_of(trees) for trees in f.rounds] for f in fits]
    weighted, sampled = any(p.weighted for p in plans), any(p.params.subsample < 1 for p in plans)

    def run(block: Block) -> Block:
        size = len(block.label)
        margins = [np.repeat(np.array(start, dtype=float)[:, None], size, axis=1) for start in starts]
        for margin, own in zip(margins, rounds):
            for trees in own:
                for k, tree in enumerate(trees):
                    margin[k] += tree.margin(block.codes)
        roles = block.roles.astype(np.min_scalar_type(int(block.roles.max(initial=0))))
        return replace(block, roles=roles, weight=block.weight if weighted else None, key=block.key if sampled else None, margins=margins)

    return run


def paths_of(trees: list[Growing]) -> list[Paths]:
    return [t.paths for t in trees]


@dataclass
class Rows:
    """Rows and the cell of each. One may stand for `number` rows, then its label is their mean and `spread` the sum of their
    squared distances from it."""

    cell: np.ndarray
    label: np.ndarray
    roles: np.ndarray
    weight: np.ndarray | None = None
    key: np.ndarray | None = None
    number: np.ndarray | None = None
    spread: np.ndarray | None = None


@dataclass
class Cells:
    """The distinct codes of a partition's rows."""

    codes: np.ndarray  # slots × cells
    merged: Rows | None  # for plans that may read rows merged
    rows: Rows | None  # for the others
    margins: list[np.ndarray]  # per plan classes × cells
    sums: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)  # of (plan, class): gradient and hessian × cells
    losses: dict[int, np.ndarray] = field(default_factory=dict)  # of a plan: watched loss and rows
    common: np.ndarray | None = None  # which of all partitions' cells each one is


def distinct(codes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each distinct column is first, which of them each column is)"""
    key, top = np.zeros(codes.shape[1], dtype=np.int64), 1
    for row in codes:
        if top > (1 << 62) // width:
            known, key = np.unique(key, return_inverse=True)
            top = len(known)
        key, top = key * width + row, top * width
    return np.unique(key, return_index=True, return_inverse=True)[1:]


def by_class(plans: list[Plan]) -> bool:
    """Whether merged rows are of one class."""
    return any(p.objective in ("logistic", "softmax") for p in plans)


def folded(plans: list[Plan], width: int, possible: float = 0) -> Callable[[Iterator[Block]], Iterator[Cells]]:
    """The cells of a partition's blocks, at the plans' starts, without rows that no plan learns from or watches. Of many more
    possible codes than rows few are equal, then each row is a cell."""
    bits = sum({1 << b for p in plans for b in (p.rows, p.watched) if b is not None})
    classes = by_class(plans)
    single, merged = any(p.by_row for p in plans), any(not p.by_row for p in plans)
    starts = [np.array(p.start, dtype=float)[:, None] for p in plans]

    def joined(parts: list[np.ndarray | None]) -> np.ndarray | None:
        return None if parts[0] is None else np.concatenate(parts, axis=-1)

    def run(blocks: Iterator[Block]) -> Iterator[Cells]:
        held = []
        for b in blocks:
            own = np.nonzero(b.roles.astype(np.int64) & bits)[0]
            if len(own):
                held.append([None if v is None else v[..., own] for v in (b.codes, b.label, b.roles, b.weight, b.key)])
        if not held:
            return
        codes, label, roles, weight, key = (joined(list(parts)) for parts in zip(*held))
        roles = roles.astype(np.min_scalar_type(int(roles.max())))
        each = possible > RARE * len(label)
        first, cell = (np.arange(len(label)),) * 2 if each else distinct(codes, width)
        rows = Rows(cell.astype(np.int32), label, roles, weight, key)
        cells = Cells(codes[:, first], None, rows if single else None, [np.repeat(s, len(first), axis=1) for s in starts])
        if merged:
            cells.merged = rows if each else merged_rows(rows, classes)
        yield cells

    return run


def merged_rows(rows: Rows, classes: bool) -> Rows:
    """One for all rows of a cell with equal roles, and of one class."""
    at = rows.cell.astype(np.int64)
    for values in (rows.roles, rows.label) if classes else (rows.roles,):
        known, place = np.unique(values, return_inverse=True)
        at = at * len(known) + place
    _, first, at = np.unique(at, return_index=True, return_inverse=True)
    times = np.ones(len(at)) if rows.number is None else rows.number
    number, label, spread = np.bincount(at, times), rows.label[first], None
    if not classes:
        label = label + np.bincount(at, (rows.label - label[at]) * times) / number
        spread = np.bincount(at, (rows.label - label[at]) ** 2 * times + (0 if rows.spread is None else rows.spread))
    weight = None if rows.weight is None else np.bincount(at, rows.weight)
    return Rows(rows.cell[first], label, rows.roles[first], weight, None, number, spread)


def names_of(codes: np.ndarray) -> np.ndarray:
    """Cells as texts of one length, which sort and compare for any number of slots."""
    return np.ascontiguousarray(codes.T).view(f"S{len(codes)}").ravel()


def codes_of(names: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(names.view(np.uint8).reshape(len(names), -1).T)


def joined_rows(a: Rows, b: Rows, classes: bool) -> Rows:
    """The merged rows of both."""
    def both(name: str) -> np.ndarray | None:
        parts = [getattr(rows, name) for rows in (a, b)]
        return None if parts[0] is None else np.concatenate(parts)

    return merged_rows(Rows(*[both(n) for n in ("cell", "label", "roles", "weight")], None, both("number"), both("spread")), classes)


def common_names(ground: RDD, room: int, classes: bool) -> tuple[np.ndarray | None, Rows | None]:
    """The distinct cells of all partitions in order, if those are at most so many and far fewer than the rows, and the merged rows
    of all partitions, if there are some and they fit into the driver."""
    def both(a: tuple, b: tuple) -> tuple:
        known, merged = None, None
        if a[0] is not None and b[0] is not None:
            known = np.unique(np.concatenate([a[0], b[0]]))
            if len(known) > room:
                known = None
            else:
                held = [replace(m, cell=np.searchsorted(known, n).astype(np.int32)[m.cell]) if m else m for n, _, m in (a, b)]
                merged = held[1] if not len(a[0]) else held[0] if not len(b[0]) else joined_rows(*held, classes) if all(held) else None
                if merged is not None and len(merged.cell) * MERGED_BYTES > COLLECTED:
                    merged = None
        return known, a[1] + b[1], merged

    def add(held: tuple, cells: Cells) -> tuple:
        rows = cells.merged if cells.rows is None else cells.rows
        number = len(rows.cell) if rows.number is None else int(rows.number.sum())
        if held[0] is None or cells.codes.shape[1] > room:
            return None, held[1] + number, None
        names, merged = names_of(cells.codes), cells.merged
        if merged is not None and merged.number is None:
            merged = merged_rows(merged, classes)
        own = np.unique(names)  # rows that are cells of their own may have equal codes
        return both(held, (own, number, merged and replace(merged, cell=np.searchsorted(own, names).astype(np.int32)[merged.cell])))

    names, rows, merged = ground.treeAggregate((np.zeros(0, dtype="S1"), 0, None), add, both)
    return (names, merged) if names is not None and 0 < len(names) * CELL_ROWS <= rows else (None, None)


def named(names: np.ndarray, merged: bool) -> Callable[[Cells], Cells]:
    """Cells that know their places among those of all partitions. The driver has their margins, and maybe the merged rows."""
    return lambda cells: replace(cells, common=np.searchsorted(names, names_of(cells.codes)).astype(np.int32), margins=[],
                                 merged=None if merged else cells.merged)


def margined(shared: Broadcast) -> Callable[[Cells], Cells]:
    """Cells with the margins the driver gives by common cell, for the plans that need them."""
    return lambda cells: replace(cells, margins=[None if m is None else m[:, cells.common] for m in shared.value])


def grown(added: dict[int, list[list[Paths]]]) -> Callable[[Cells], Cells]:
    """Margins with more rounds of some plans."""
    def run(cells: Cells) -> Cells:
        margins = list(cells.margins)
        for m, rounds in added.items():
            margins[m] = margins[m].copy()
            for trees in rounds:
                for k, tree in enumerate(trees):
                    margins[m][k] += tree.margin(cells.codes)
        return replace(cells, margins=margins)

    return run


def summed(plans: list[Plan], growing: list[int], number: int, losses: bool) -> Callable[[Cells], Cells]:
    """Gradient and hessian by cell of the plans that grow, and their watched losses: what the jobs of the levels read."""
    def run(cells: Cells) -> Cells:
        sums, lost = {}, {}
        for m in growing:
            plan = plans[m]
            rows = cells.rows if plan.by_row else cells.merged
            margin = cells.margins[m][:, rows.cell]
            if losses and plan.watched is not None:
                seen = (rows.roles >> plan.watched & 1).astype(bool)
                values = plan.losses(margin[:, seen], rows.label[seen])
                if rows.number is not None:
                    values = values * rows.number[seen]
                if rows.spread is not None:
                    values = values + rows.spread[seen]
                lost[m] = np.array([values.sum(), seen.sum() if rows.number is None else rows.number[seen].sum()])
            used = (rows.roles >> plan.rows & 1).astype(bool)
            if plan.params.subsample < 1:
                used &= drawn(rows.key, plan.params.subsample, plan.seed * 1_000_003 + number)
            times = rows.weight if plan.weighted else rows.number
            times = used.astype(float) if times is None else np.where(used, times, 0.0)
            for k, (g, h) in enumerate(zip(*plan.gradients(margin, rows.label))):
                sums[m, k] = np.stack([np.bincount(rows.cell, v * times, cells.codes.shape[1]) for v in (g, h)])
        return Cells(cells.codes, None, None, [], sums, lost, cells.common)

    return run


def cell_sums(pairs: list[tuple[int, int]], count: int, step: int) -> Callable[[Iterator[Cells]], Iterator[tuple]]:
    """Sums of a partition: ((plan, class, place), gradient and hessian of `step` of the `count` common cells from a place on), and
    ((plan, -1, 0), watched loss and rows)."""
    def run(held: Iterator[Cells]) -> Iterator[tuple]:
        for cells in held:  # one of a partition
            for m, k in pairs:
                sums = np.stack([np.bincount(cells.common, v, count) for v in cells.sums[m, k]])
                yield from (((m, k, at), sums[:, at : at + step]) for at in range(0, count, step))
            yield from (((m, -1, 0), values) for m, values in cells.losses.items())

    return run


def drawn(key: np.ndarray, share: float, seed: int) -> np.ndarray:
    """A sample of rows by a hash of their keys."""
    if share >= 1:
        return np.ones(len(key), dtype=bool)
    x = key.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < np.uint64(int(share * (1 << 53)))


def histograms(growing: dict[int, list[Paths]], taken: np.ndarray, losses: bool) -> Callable:
    """Sums of a partition: ((plan, class), 2 × open nodes × codes that are taken), and ((plan, -1), watched loss and rows)."""
    def run(held: Iterator[Cells]) -> Iterator[tuple]:
        for cells in held:  # one of a partition
            for m, trees in growing.items():
                for k, tree in enumerate(trees):
                    if not tree.open:
                        continue
                    width, count = tree.table.shape[1], len(tree.open)
                    place = np.full(len(tree.slot), count * width)
                    place[list(tree.open)] = np.arange(count) * width
                    # Cells whose node is closed are counted beyond the last open node.
                    base = place.take(tree.place(cells.codes))
                    sums = np.empty((2, len(cells.codes), count * width))
                    for slot, codes in enumerate(cells.codes):
                        at = base + codes
                        for kind, values in enumerate(cells.sums[m, k]):
                            sums[kind, slot] = np.bincount(at, values, (count + 1) * width)[: count * width]
                    yield (m, k), sums.reshape(2, len(cells.codes), count, width).transpose(0, 2, 1, 3)[:, :, taken]
            if losses:
                yield from (((m, -1), values) for m, values in cells.losses.items())

    return run


def summary(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A sorted sample of at most SUMMARY points, each standing for an equal share of the weight. Without weights each value weighs one."""
    if weights is None:
        values, weights = np.sort(values), np.ones(len(values))
    else:
        order = np.argsort(values, kind="stable")
        values, weights = values[order], weights[order]
    if len(values) <= SUMMARY:
        return values, weights
    upto = np.cumsum(weights)
    marks = (np.arange(SUMMARY) + 0.5) / SUMMARY * upto[-1]
    return values[np.minimum(np.searchsorted(upto, marks), len(values) - 1)], np.full(SUMMARY, upto[-1] / SUMMARY)


def merged_summary(a: tuple, b: tuple) -> tuple:
    return summary(np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]))


def quantile_of(held: tuple, share: float) -> float:
    values, weights = held
    upto = np.cumsum(weights) - weights / 2
    return float(np.interp(share * weights.sum(), upto, values))


def residual_summaries(plans: list[Plan], growing: dict[int, list[Paths]]) -> Callable:
    """((plan, leaf), summary of label minus margin) of a partition, for quantile plans."""
    def run(held: Iterator[Cells]) -> Iterator[tuple]:
        found: dict[tuple[int, int], tuple] = {}
        for cells in held:
            rows = cells.rows
            for m, (tree,) in growing.items():
                used = (rows.roles >> plans[m].rows & 1).astype(bool)
                cell = rows.cell[used]
                at, apart = tree.place(cells.codes)[cell], rows.label[used] - cells.margins[m][0][cell]
                weight = rows.weight[used] if plans[m].weighted else None
                order = np.argsort(at.astype(np.int32 if len(tree.slot) >> 15 else np.int16), kind="stable")  # short integers sort by their bytes
                leaves, begin = np.unique(at[order], return_index=True)
                for leaf, own in zip(leaves.tolist(), np.split(order, begin[1:])):
                    own = summary(apart[own], None if weight is None else weight[own])
                    found[m, leaf] = merged_summary(found[m, leaf], own) if (m, leaf) in found else own
        yield from found.items()

    return run


# ---------------------------------------------------------------- the rounds


def boost(blocks: RDD, plans: list[Plan], bins: Bins, fits: list[Fit] | None = None, patience: int = PATIENCE) -> list[Fit]:
    """Grow all plans together until each has ended; ``fits`` continues earlier ones. A plan with a watched loss returns
    the rounds up to the least, one with a leader as many as its leader."""
    fits = [Fit(p, list(f.rounds), f.losses[: len(f.rounds)]) for p, f in zip(plans, fits)] if fits else [Fit(p) for p in plans]
    cores = blocks.context.defaultParallelism
    taken = bins.taken
    ground = blocks.map(started(plans, [Fit(p) for p in plans])).mapPartitions(folded(plans, bins.width, float(np.prod(taken.sum(axis=1, dtype=float)))))
    ground.persist(StorageLevel.MEMORY_AND_DISK)
    names, merged = common_names(ground, COLLECTED // (16 * len(taken) * sum(p.classes for p in plans)), by_class(plans))
    table = levels = None
    # Plans whose rows the driver has.
    local = {m for m, p in enumerate(plans) if merged is not None and not p.by_row}
    # Margins and rows, read once or twice a round, and the sums by cell, read for each level.
    whole = state = placed = ground
    shared: Broadcast | None = None
    if names is not None:
        placed = ground.map(named(names, merged is not None)).persist(StorageLevel.MEMORY_AND_DISK)
        table = Cells(codes_of(names), merged, None, [np.repeat(np.array(p.start, dtype=float)[:, None], len(names), axis=1) for p in plans])
        table = grown({m: [paths_of(trees) for trees in f.rounds] for m, f in enumerate(fits)})(table)
    added: dict[int, list[Growing]] = {}
    rounds = 0

    def wanted(m: int) -> bool:
        plan = plans[m]
        if plan.leader is None or wanted(plan.leader):
            return not fits[m].ended(patience)
        return len(fits[m].rounds) < min(fits[plan.leader].best, plan.params.n_estimators)

    def spread(values: np.ndarray) -> np.ndarray:
        """nodes × 2 × slots × codes"""
        out = np.zeros((values.shape[1], 2, *taken.shape))
        out[:, :, taken] = values.transpose(1, 0, 2)
        return out

    def of_all(growing: dict[int, list[Growing]]) -> Cells:
        """The common cells with the sums of all partitions."""
        count = table.codes.shape[1]
        own = summed(plans, [m for m in growing if m in local], number, bool(added))(table)
        sums, lost = own.sums, own.losses
        far = {m: trees for m, trees in growing.items() if m not in local}
        if not far:
            return own
        pairs = [(m, k) for m, trees in far.items() for k in range(len(trees))]
        collected = placed.getNumPartitions() * len(pairs) * count * 16 <= COLLECTED
        held = whole.map(summed(plans, list(far), number, bool(added))).mapPartitions(cell_sums(pairs, count, count if collected else -(-count // cores)))
        if not collected:
            held = held.reduceByKey(lambda a, b: a + b, cores)
        sums |= {pair: np.zeros((2, count)) for pair in pairs}
        for (m, k, at), values in held.collect():
            if k < 0:
                lost[m] = lost.get(m, 0) + values
            else:
                sums[m, k][:, at : at + values.shape[1]] += values
        return replace(own, sums=sums, losses=lost)

    def job(growing: dict[int, list[Growing]], losses: bool) -> dict:
        """{(plan, class): {node: (weight, cover, split)}} and {(plan, -1): watched loss and rows}"""
        for trees in growing.values():
            for tree in trees:
                tree.pack()
        paths = {m: paths_of(trees) for m, trees in growing.items()}
        searches = {(m, k): Search(plans[m].params, bins, columns[m], plans[m].rules) for m, trees in growing.items() for k in range(len(trees))}
        bounds = {(m, k): np.array([t.bounds[n] for n in t.open]) for m, trees in growing.items() for k, t in enumerate(trees)}
        nodes = sum(len(b) for b in bounds.values())
        sums = histograms(paths, taken, losses)

        def found(key: tuple[int, int], values: np.ndarray) -> object:
            """values: the sums of all open nodes."""
            if key[1] < 0:
                return values
            return dict(zip(paths[key[0]][key[1]].open, searches[key].best(spread(values), bounds[key])))

        if levels is not None:
            return {key: found(key, values) for key, values in sums(iter([levels]))}
        sums = state.mapPartitions(sums)
        if state.getNumPartitions() * nodes * int(taken.sum()) * 16 <= COLLECTED:
            total: dict = {}
            for key, values in sums.collect():
                total[key] = total[key] + values if key in total else values
            return {key: found(key, values) for key, values in total.items()}

        def by_node(item: tuple) -> Iterator[tuple]:
            key, values = item
            if key[1] < 0:
                return iter([((*key, -1), values)])
            return (((*key, place), values[:, place : place + 1]) for place in range(values.shape[1]))

        def split(item: tuple) -> tuple:
            (m, k, place), values = item
            return (m, k, place), values if k < 0 else searches[m, k].best(spread(values), bounds[m, k][place : place + 1])[0]

        reducers = max(1, min(cores, nodes // REDUCER_NODES))
        out: dict = {}
        for (m, k, place), result in sums.flatMap(by_node).reduceByKey(lambda a, b: a + b, reducers).map(split).collect():
            if k < 0:
                out[m, k] = result
            else:
                out.setdefault((m, k), {})[paths[m][k].open[place]] = result
        return out

    while True:
        number = max(len(f.rounds) for f in fits)
        growing = {m: [Growing(bins) for _ in range(plans[m].classes)] for m in range(len(plans)) if wanted(m)}
        # The last round's watched losses come with the next round's first sums, also of plans that end with it.
        growing |= {m: [] for m in added if m not in growing and plans[m].watched is not None}
        if not growing:
            break
        old = {}
        if table is not None:
            table = grown({m: [paths_of(trees)] for m, trees in added.items()})(table)
            if any(m not in local for m in growing):
                if shared is not None:
                    shared.destroy()
                shared = blocks.context.broadcast([table.margins[m] if m in growing and m not in local else None for m in range(len(plans))])
                whole = placed.map(margined(shared))
            levels = of_all(growing)
            ground.unpersist()  # its rows are in placed now, or in the driver
        else:
            if rounds % REBUILD == 0:
                fresh = ground.map(grown({m: [paths_of(trees) for trees in f.rounds] for m, f in enumerate(fits)}))
            else:
                fresh = whole.map(grown({m: [paths_of(trees)] for m, trees in added.items()}))
            old = {r.id(): r for r in (whole, state) if r is not ground}
            whole = fresh.persist(StorageLevel.MEMORY_AND_DISK)
            state = whole.map(summed(plans, list(growing), number, bool(added))).persist(StorageLevel.MEMORY_AND_DISK)
        columns = {m: _columns(plans[m], len(fits[m].rounds), len(bins.edges)) for m in growing}
        found = job(growing, bool(added))
        for done in old.values():
            done.unpersist()
        for m in added:
            if plans[m].watched is not None and (m, -1) in found:
                total, seen = found[m, -1]
                fits[m].losses.append(plans[m].mean_loss(total, seen) if seen else math.nan)
        growing = {m: trees for m, trees in growing.items() if trees and wanted(m)}
        added = {}
        if not growing:
            break
        for level in range(max(plans[m].params.max_depth for m in growing)):
            if level:
                if not any(t.open for trees in growing.values() for t in trees):
                    break
                found = job(growing, False)
            for m, trees in growing.items():
                for k, tree in enumerate(trees):
                    tree.open = _split_level(tree, plans[m], found.get((m, k), {}) if tree.open else {}, level)
                    tree.depth = level + 1
        for m, trees in growing.items():
            for tree in trees:
                tree.value = [v * plans[m].params.learning_rate for v in tree.value]
                tree.open = []
                tree.pack()
        quantiles = {m: trees for m, trees in growing.items() if plans[m].objective == "quantile"}
        if quantiles:
            held = whole.mapPartitions(residual_summaries(plans, {m: paths_of(t) for m, t in quantiles.items()}))
            leaves = sum(t.left.count(-1) for (t,) in quantiles.values())
            if placed.getNumPartitions() * leaves * SUMMARY * 16 > COLLECTED:
                held = held.reduceByKey(merged_summary, max(1, min(cores, leaves // REDUCER_NODES)))
            summaries: dict = {}
            for key, own in held.collect():
                summaries[key] = merged_summary(summaries[key], own) if key in summaries else own
            for (m, leaf), own in summaries.items():
                growing[m][0].value[leaf] = plans[m].params.learning_rate * quantile_of(own, plans[m].share)
            for trees in quantiles.values():
                trees[0].pack()
        for m, trees in growing.items():
            fits[m].rounds.append(trees)
        added = growing
        rounds += 1
    if shared is not None:
        shared.destroy()
    for done in (state, whole, placed, ground):
        done.unpersist()
    out = []
    for m, fit in enumerate(fits):
        leader = plans[m].leader
        out.append(fit.cut(fit.best if leader is None else min(fits[leader].best, plans[m].params.n_estimators)) if fit.losses or leader is not None else fit)
        if fit.losses:
            out[-1].losses = fit.losses  # the whole curve, beyond the round that was kept
    return out


def _columns(plan: Plan, number: int, slots: int) -> tuple[int, ...]:
    """The slots a round's trees may test."""
    count = max(1, round(plan.params.colsample * slots))
    if count >= slots:
        return tuple(range(slots))
    return tuple(sorted(np.random.default_rng((plan.seed, number)).choice(slots, count, replace=False).tolist()))


def _split_level(tree: Growing, plan: Plan, found: dict[int, tuple], level: int) -> list[int]:
    """Split the open nodes; returns the new ones, if the tree may go deeper."""
    opened = []
    for node, (weight, cover, split) in sorted(found.items()):
        if level == 0:
            tree.value[0], tree.cover[0] = weight, cover
        if split is not None:
            tree.split(node, split, plan.rules.get(split.slot, 0) if plan.rules else 0)
            opened += [tree.left[node], tree.right[node]]
    return opened if level + 1 < plan.params.max_depth else []
