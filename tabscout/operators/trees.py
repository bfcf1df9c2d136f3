"""Fitted tree ensembles as small arrays, and what can be read from them.

Trees are shipped to the executors as a broadcast of a few kilobytes each. Predictions and SHAP values are then
Arrow-batched array arithmetic on rows where they already lie: nothing is shuffled. Rows that no test tells apart are in one
cell and have equal results; each Python worker remembers a bounded number of them.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscout.errors import TabularError

ALL_PATTERNS = 8  # path features up to which every combination is tabulated at once
KNOWN_BYTES = 32 << 20  # results a forest remembers on an executor


@dataclass
class Tree:
    """One tree as parallel arrays indexed by node id. A missing value is NaN."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    cover: np.ndarray
    value: np.ndarray  # nodes × outputs
    categories: dict[int, np.ndarray] = field(default_factory=dict)  # node -> categories going left
    missing_left: np.ndarray | None = None  # per node, none: right
    gain: np.ndarray | None = None

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        values = x[:, self.feature[node]]
        left = np.isin(values, self.categories[node]) if node in self.categories else values <= self.threshold[node]
        if self.missing_left is not None and self.missing_left[node]:
            left = left | np.isnan(values)
        return left

    def predict(self, x: np.ndarray) -> np.ndarray:
        slot, rows, at = np.maximum(self.feature, 0), np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
        missing_left = np.zeros(len(slot), dtype=bool) if self.missing_left is None else self.missing_left
        sets = None
        if self.categories:
            # Per node a table of categories; the last column holds whatever no set names.
            sets = np.zeros((len(slot), int(max(c.max(initial=0) for c in self.categories.values())) + 2), dtype=bool)
            for node, inside in self.categories.items():
                sets[node, inside.astype(int)] = True
            by_set = np.isin(np.arange(len(slot)), list(self.categories))
        while (inner := self.left[at] >= 0).any():
            values = x[rows, slot[at]]
            missing = np.isnan(values)
            left = values <= self.threshold[at]
            if sets is not None:
                place = np.where(missing | (values < 0) | (values >= sets.shape[1]), sets.shape[1] - 1, values).astype(np.int64)
                left = np.where(by_set[at], sets[at, place], left)
            left = np.where(missing, missing_left[at], left)
            at = np.where(inner, np.where(left, self.left[at], self.right[at]), at)
        return self.value[at]


def shapley_table(present: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Weights of each path feature for each presence pattern (Lundberg et al. 2018).

    ``present`` is patterns × features (the row satisfies every split on the feature),
    ``shares`` the fraction of training cover following the path when it is unknown.
    """
    patterns, m = present.shape
    result = np.empty((patterns, m))
    weights = [factorial(s) * factorial(m - s - 1) / factorial(m) for s in range(m)]
    for j in range(m):
        sums = [np.ones(patterns)]  # by number of known features
        for k in range(m):
            if k == j:
                continue
            grown = [np.zeros(patterns) for _ in range(len(sums) + 1)]
            for s, term in enumerate(sums):
                grown[s] += term * shares[k]
                grown[s + 1] += term * present[:, k]
            sums = grown
        result[:, j] = (present[:, j] - shares[j]) * sum(w * t for w, t in zip(weights, sums))
    return result


@dataclass
class _Leaf:
    value: np.ndarray
    features: list[int]
    shares: np.ndarray
    tests: list[list[tuple[int, bool]]]  # per feature: (node, left?)
    table: np.ndarray | None


class Known:
    """Results by cell, sorted; beyond KNOWN_BYTES no more are kept."""

    def __init__(self, width: int):
        self.cells, self.results = np.zeros(0, dtype=np.int64), np.zeros((0, width))
        self.room = KNOWN_BYTES // (8 * (width + 1))

    def of(self, cells: np.ndarray, work) -> np.ndarray:
        """The result of each cell; ``work`` gives those of rows that stand for cells not met before."""
        own, first, place = np.unique(cells, return_index=True, return_inverse=True)
        at = np.searchsorted(self.cells, own)
        new = np.ones(len(own), dtype=bool)
        inside = at < len(self.cells)
        new[inside] = self.cells[at[inside]] != own[inside]
        out = np.empty((len(own), self.results.shape[1]))
        out[~new] = self.results[at[~new]]
        if new.any():
            out[new] = work(first[new])
            if len(self.cells) + new.sum() <= self.room:
                self.cells, self.results = np.insert(self.cells, at[new], own[new]), np.insert(self.results, at[new], out[new], axis=0)
        return out[place]


class Forest:
    """A base output plus a weighted sum of trees."""

    def __init__(self, trees: list[Tree], weights: list[float], slots: int, base: np.ndarray | None = None):
        self.trees, self.weights, self.slots = trees, weights, slots
        self.base = base if base is not None else np.zeros(trees[0].value.shape[1])
        self._leaves: list[list[_Leaf]] | None = None
        self._bias: np.ndarray | None = None
        self._marks: list[tuple[np.ndarray, bool] | None] | None = None
        self._known: dict[str, Known] = {}

    def __getstate__(self):
        own = {"trees": self.trees, "weights": self.weights, "slots": self.slots, "base": self.base}
        return {**own, "_leaves": None, "_bias": None, "_marks": None, "_known": {}}

    @property
    def outputs(self) -> int:
        return len(self.base)

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.repeat(self.base[None, :].astype(float), len(x), axis=0)
        for tree, w in zip(self.trees, self.weights):
            total += w * tree.predict(x)
        return total

    def marks(self) -> list[tuple[np.ndarray, bool] | None]:
        """Per slot the values its tests name, in order, and whether some name categories; None where nothing is tested."""
        if self._marks is None:
            named: list[list[np.ndarray]] = [[] for _ in range(self.slots)]
            sets = [False] * self.slots
            for tree in self.trees:
                for node in np.flatnonzero(tree.left >= 0).tolist():
                    slot = int(tree.feature[node])
                    sets[slot] |= node in tree.categories
                    named[slot].append(tree.categories[node] if node in tree.categories else tree.threshold[node : node + 1])
            self._marks = [(np.unique(np.concatenate(n).astype(float)), s) if n else None for n, s in zip(named, sets)]
        return self._marks

    def cells(self, x: np.ndarray) -> np.ndarray | None:
        """A number per row, equal for rows that every test of every tree sends the same way; None if too many are possible."""
        out, top = np.zeros(len(x), dtype=np.int64), 1
        for slot, mark in enumerate(self.marks()):
            if mark is None:
                continue
            values, sets = mark
            own = x[:, slot]
            code = np.searchsorted(values, own)
            size = len(values) + 1
            if sets:  # equal to a value and beyond it are told apart
                code = 2 * code + (np.append(values, np.nan)[code] == own)
                size *= 2
            code = np.where(np.isnan(own), size, code)
            if top > (1 << 62) // (size + 1):
                return None
            out, top = out * (size + 1) + code, top * (size + 1)
        return out if top <= (1 << 62) // max(self.outputs, 1) else None

    def known_margins(self, x: np.ndarray) -> np.ndarray:
        """``predict``, computed once for rows of one cell."""
        cells = self.cells(x)
        if cells is None:
            return self.predict(x)
        return self._known.setdefault("margins", Known(self.outputs)).of(cells, lambda rows: self.predict(x[rows]))

    def known_shap(self, x: np.ndarray, output: np.ndarray) -> np.ndarray:
        """``shap``, computed once for rows of one cell and output."""
        cells = self.cells(x)
        if cells is None:
            return self.shap(x, output)
        return self._known.setdefault("shap", Known(self.slots)).of(cells * self.outputs + output, lambda rows: self.shap(x[rows], output[rows]))

    def leaves(self) -> list[list[_Leaf]]:
        if self._leaves is None:
            self._leaves = [_leaf_paths(t) for t in self.trees]
        return self._leaves

    def bias(self) -> np.ndarray:
        """The expected output before any feature is known."""
        if self._bias is None:
            self._bias = self.base + sum(
                (w * sum(leaf.value * float(np.prod(leaf.shares)) for leaf in leaves) for leaves, w in zip(self.leaves(), self.weights)),
                np.zeros(self.outputs),
            )
        return self._bias

    def gains(self) -> np.ndarray:
        """Mean gain of the splits on each slot."""
        total, splits = np.zeros(self.slots), np.zeros(self.slots)
        for tree in self.trees:
            inner = tree.left >= 0
            np.add.at(total, tree.feature[inner], tree.gain[inner])
            np.add.at(splits, tree.feature[inner], 1)
        return np.divide(total, splits, out=total, where=splits > 0)

    def shap(self, x: np.ndarray, output: np.ndarray | int) -> np.ndarray:
        """Contribution of each vector slot; ``output`` picks one output, or one per row."""
        pick = np.broadcast_to(np.asarray(output), (len(x),))
        phi = np.zeros((self.slots, len(x)))
        for wanted in np.unique(pick):
            rows = np.flatnonzero(pick == wanted)
            own, sums = x[rows], np.zeros((self.slots, len(rows)))
            for tree, leaves, w in zip(self.trees, self.leaves(), self.weights):
                if tree.value[:, wanted].any():
                    self._add_tree(sums, tree, leaves, w, own, wanted)
            phi[:, rows] = sums
        return phi.T

    @staticmethod
    def _add_tree(sums: np.ndarray, tree: Tree, leaves: list[_Leaf], w: float, x: np.ndarray, output: int) -> None:
        left = {n: tree.goes_left(n, x) for n in range(len(tree.feature)) if tree.left[n] >= 0}
        right = {n: ~v for n, v in left.items()}
        for leaf in leaves:
            factor = w * leaf.value[output]
            if not leaf.features or not factor:
                continue
            code = np.zeros(len(x), dtype=np.uint8 if leaf.table is not None else np.int64)
            for j, tests in enumerate(leaf.tests):
                node, to_left = tests[0]
                ok = left[node] if to_left else right[node]
                for node, to_left in tests[1:]:
                    ok = ok & (left[node] if to_left else right[node])
                code |= ok.astype(code.dtype) << code.dtype.type(j)
            if leaf.table is not None:
                table = leaf.table * factor
            else:
                seen, code = np.unique(code, return_inverse=True)
                bits = (seen[:, None] >> np.arange(len(leaf.features))) & 1
                table = shapley_table(bits.astype(float), leaf.shares) * factor
            for j, slot in enumerate(leaf.features):
                sums[slot] += table[code, j]


def _leaf_paths(tree: Tree) -> list[_Leaf]:
    leaves: list[_Leaf] = []

    def walk(node: int, path: dict[int, tuple[float, list[tuple[int, bool]]]]) -> None:
        if tree.left[node] < 0:
            features = list(path)
            shares = np.array([path[f][0] for f in features])
            m = len(features)
            table = None
            if 0 < m <= ALL_PATTERNS:
                bits = (np.arange(2**m)[:, None] >> np.arange(m)) & 1
                table = shapley_table(bits.astype(float), shares)
            leaves.append(_Leaf(tree.value[node], features, shares, [path[f][1] for f in features], table))
            return
        slot = int(tree.feature[node])
        for child, to_left in ((tree.left[node], True), (tree.right[node], False)):
            share, tests = path.get(slot, (1.0, []))
            ratio = float(tree.cover[child]) / float(tree.cover[node])
            walk(int(child), {**path, slot: (share * ratio, [*tests, (node, to_left)])})

    walk(0, {})
    return leaves


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder that the driver and all executors share: under the session's checkpoint folder; a session on one machine
    may use its warehouse instead."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise TabularError("NO_SHARED_FOLDER", "Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        base = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/scratch"
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder through the file system it is on."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def saved_nodes(spark: SparkSession, model) -> list:
    """The nodes of a fitted tree model, bounded by its trees × 2^depth."""
    path = scratch_path(spark, "model")
    model.write().save(path)
    try:
        return node_table(spark, path).collect()
    finally:
        drop_scratch(spark, path)


def node_table(spark: SparkSession, path: str) -> DataFrame:
    """One row per node of a saved tree model."""
    raw = spark.read.parquet(f"{path}/data")
    nodes = raw.select("treeID", "nodeData.*") if "nodeData" in raw.columns else raw.select(F.lit(0).alias("treeID"), "*")
    return nodes.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), "prediction", "impurityStats",
        F.col("rawCount").alias("rows"), "gain", F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("slot"), F.col("split.leftCategoriesOrThreshold").alias("test"),
        F.col("split.numCategories").alias("categories"),
    )


FOREST_SCHEMA = ("tree int, node int, slot int, threshold double, categories array<double>, missing_left boolean, left int, right int, "
                 "cover double, gain double, value array<double>")


def forest_table(spark: SparkSession, forest: Forest) -> DataFrame:
    """One row per node. A threshold beyond all numbers, which parts missing values from known ones, is infinite."""
    rows = [
        (i, n, int(t.feature[n]), float(t.threshold[n]), t.categories[n].tolist() if n in t.categories else None,
         bool(t.missing_left[n]) if t.missing_left is not None else False, int(t.left[n]), int(t.right[n]), float(t.cover[n]),
         float(t.gain[n]) if t.gain is not None else 0.0, [float(v) * w for v in t.value[n]])
        for i, (t, w) in enumerate(zip(forest.trees, forest.weights)) for n in range(len(t.feature))
    ]
    return spark.createDataFrame(rows, FOREST_SCHEMA)


def forest_of(nodes: DataFrame, slots: int, base: list[float]) -> Forest:
    """The forest of a node table, bounded by its trees × 2^depth."""
    grouped: dict[int, list] = {}
    for r in nodes.collect():
        grouped.setdefault(r["tree"], []).append(r)
    trees = []
    for i in sorted(grouped):
        rows = sorted(grouped[i], key=lambda r: r["node"])
        whole = lambda name, kind: np.array([r[name] for r in rows], dtype=kind)
        sets = {r["node"]: np.array(r["categories"], dtype=float) for r in rows if r["categories"] is not None}
        trees.append(Tree(whole("slot", int), whole("threshold", float), whole("left", int), whole("right", int), whole("cover", float),
                          whole("value", float), sets, whole("missing_left", bool), whole("gain", float)))
    return Forest(trees, [1.0] * len(trees), slots, np.array(base, dtype=float))


# ---------------------------------------------------------------- on executors


def _matrix(arrays: pa.Array) -> np.ndarray:
    return np.asarray(arrays.flatten()).reshape(len(arrays), -1) if len(arrays) else np.zeros((0, 1))


def _lists(rows: np.ndarray) -> pa.Array:
    size, width = rows.shape
    return pa.ListArray.from_arrays(np.arange(0, (size + 1) * width, width, dtype=np.int32), pa.array(np.ascontiguousarray(rows).ravel()))


def _none() -> pa.Array:
    return pa.array([], pa.list_(pa.float64()))


def shap_column(spark: SparkSession, forest: Forest, groups: list[int], features: Column, output: Column) -> Column:
    """array<double>: one contribution per source feature, the bias last.

    ``groups`` maps vector slots to source features; ``output`` is the class index per row.
    """
    shared = spark.sparkContext.broadcast((forest, np.array(groups), max(groups) + 1))

    @F.arrow_udf("array<double>")
    def explain(vectors: pa.Array, outputs: pa.Array) -> pa.Array:
        trees, slots, width = shared.value
        if not len(vectors):
            return _none()
        x = _matrix(vectors)
        pick = np.asarray(outputs).astype(int)
        phi = trees.known_shap(x, pick)
        merged = np.zeros((len(x), width + 1))
        for slot, group in enumerate(slots):
            merged[:, group] += phi[:, slot]
        merged[:, width] = trees.bias()[pick]
        return _lists(merged)

    return explain(features, output)


def margin_column(spark: SparkSession, forest: Forest, features: Column) -> Column:
    """array<double>: the ensemble's outputs."""
    shared = spark.sparkContext.broadcast(forest)

    @F.arrow_udf("array<double>")
    def score(vectors: pa.Array) -> pa.Array:
        return _lists(shared.value.known_margins(_matrix(vectors))) if len(vectors) else _none()

    return score(features)
