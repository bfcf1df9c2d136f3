"""SimHash near-duplicates: vantage-point trees over Hamming distance find every pair of close fingerprints.

Equal fingerprints are one point. The 64 bits are cut into bands with radii chosen so that two points within the wanted
distance are within the radius in at least one band (distances of bands add up). For each band a vantage-point tree
over the band's Hamming distance is fitted to a bounded sample and sent to all tasks. Every point then walks the tree:
a node sends it inside (distance to the vantage point at most the node's bound) or outside, and by the triangle
inequality a point inside can only be close to one outside if it lies within the radius of the bound, so just those
points visit both shards. Shards are compared exactly, over all 64 bits, in blocks of bounded size, and a shard returns
the links of its local components only, never all pairs. Components of the links are joined across shards.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows have equal
fingerprints; an empty table gives no rows; other columns are kept by `deduplicated` and ignored by `near_groups`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tabscout.llm.common import documents_text, in_batches, join_by_key, values, written
from tabscout.llm.graph import components
from tabscout.llm.rules import row_key, rows_with_key

WORDS, SEED, DISTANCE = 4, 42, 4
BANDS, SAMPLE, SHARD, BLOCK = 3, 32_768, 1000, 20_000
FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprint(text: str, words: int = WORDS) -> int:
    """A bit is one if it is set in over half of the hashes of the text's word shingles, repeats included."""
    found = text.encode().lower().split()  # bytes: only A-Z change, and the blanks are the six ASCII ones
    if not found:
        return 0
    shingles = [b" ".join(found[k : k + words]) for k in range(max(1, len(found) - words + 1))]
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(shingles), 1 << 15):
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[k : k + (1 << 15)]], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, extra: list | None = None) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed number), with further columns passed through."""
    extra = extra or []
    rows = docs.select("doc_id", documents_text(docs).alias("text"), *extra)
    names = [c for c in rows.columns if c not in ("doc_id", "text")]
    schema = ", ".join(["doc_id long", *(f"{n} {dict(rows.dtypes)[n]}" for n in names), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            found = np.array([fingerprint(t) for t in texts], dtype="<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array(found, pa.int64())], names=["doc_id", *names, "fp"])

    return rows.mapInArrow(run, schema)


def bands(distance: int, count: int = BANDS) -> list[tuple[int, int]]:
    """(mask, radius) of each band: the radii plus one add up to distance + 1, so one band is always within its own."""
    shares = [(distance + 1) // count + (k < (distance + 1) % count) for k in range(count)]
    shares = [s for s in shares if s]
    widths = [64 // len(shares) + (k < 64 % len(shares)) for k in range(len(shares))]
    out, low = [], 0
    for width, share in zip(widths, shares):
        out.append((((1 << width) - 1) << low, share - 1))
        low += width
    return out


class Tree:
    """A vantage-point tree over one band. Nodes are rows of arrays; children below zero are shards."""

    def __init__(self, sample: np.ndarray, mask: int, radius: int, leaf: int):
        self.mask, self.radius = np.uint64(mask), radius
        self.vantage, self.bound, self.children = [], [], []
        self.shards = 0
        self.root = self._grow(np.unique(sample & self.mask), leaf, np.random.default_rng(mask & 0xFFFF))

    def _grow(self, points: np.ndarray, leaf: int, rng) -> int:
        if len(points) > leaf:
            for _ in range(4):
                vantage = points[rng.integers(len(points))]
                far = np.bitwise_count((points ^ vantage) & self.mask)
                bound = int(np.median(far))
                inside = far <= bound
                if 0 < inside.sum() < len(points):
                    node = len(self.vantage)
                    self.vantage.append(vantage)
                    self.bound.append(bound)
                    self.children.append(None)
                    # Points that visit both sides grow both samples, so depth follows what shards will hold.
                    self.children[node] = (self._grow(points[inside], leaf, rng), self._grow(points[~inside], leaf, rng))
                    return node
        self.shards += 1
        return -self.shards

    def route(self, points: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(shard, indices of the points that belong or visit there)."""
        waiting = [(self.root, np.arange(len(points)))]
        while waiting:
            node, index = waiting.pop()
            if node < 0:
                yield -node - 1, index
                continue
            far = np.bitwise_count((points[index] ^ self.vantage[node]) & self.mask)
            inside, outside = self.children[node]
            for child, own in ((inside, index[far <= self.bound[node]]), (outside, index[far.astype(np.int16) > self.bound[node] - self.radius])):
                if len(own):
                    waiting.append((child, own))


def local_labels(a: np.ndarray, b: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """The labels after joining a[k] with b[k] for all k: the least label of each component."""
    while len(a):
        least = np.minimum(labels[a], labels[b])
        np.minimum.at(labels, labels[a], least)
        np.minimum.at(labels, labels[b], least)
        while not np.array_equal(jumped := labels[labels], labels):
            labels = jumped
        apart = labels[a] != labels[b]
        a, b = a[apart], b[apart]
    return labels


def close_links(points: np.ndarray, blocks: np.ndarray, across: bool, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (point, its component's first point) of the points within the distance. across: only between blocks."""
    order = np.lexsort((points, blocks)) if across else np.argsort(points)
    points, blocks = points[order], blocks[order]
    n = len(points)
    labels = np.arange(n)
    rows, columns = np.arange(n), np.arange(n)
    if across:
        first = int((blocks == blocks[0]).sum())
        rows, columns = np.arange(first), np.arange(first, n)
    step = max(1, (4 << 20) // max(1, len(columns)))
    for k in range(0, len(rows), step):
        part = rows[k : k + step]
        near = np.bitwise_count(points[part][:, None] ^ points[columns][None, :]) <= distance
        i, j = np.nonzero(near)
        a, b = part[i], columns[j]
        apart = labels[a] != labels[b]
        labels = local_labels(a[apart], b[apart], labels)
    linked = np.nonzero(labels != np.arange(n))[0]
    return points[linked], points[labels[linked]]


def close_fingerprints(points: DataFrame, distance: int = DISTANCE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """points: distinct (fp). Returns links (a, b) whose components are those of all pairs within the distance."""
    count = points.count()
    # About SAMPLE of the points, by a hash of each; no task sends more than its share.
    part = int(min(1.0, SAMPLE / max(count, 1)) * (1 << 40))
    sample = points.filter(F.shiftrightunsigned(F.xxhash64("fp"), 24) < part).select("fp").toPandas().fp
    sample = np.sort(sample.to_numpy(dtype="<i8")).view("<u8")
    leaf = max(2, int(len(sample) * shard / max(count, 1)))
    trees = points.sparkSession.sparkContext.broadcast([Tree(sample, mask, radius, leaf) for mask, radius in bands(distance)])

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).view("<u8")
            for number, tree in enumerate(trees.value):
                for name, index in tree.route(own):
                    yield pa.record_batch([pa.array(np.full(len(index), number << 32 | name, dtype=np.int64)), pa.array(own[index].view("<i8"))], names=["shard", "fp"])

    # Shards may hold more than the sample foretells; then their points are dealt to blocks, compared two by two.
    placed = written(points.select("fp").mapInArrow(routed, "shard long, fp long"))
    sizes = placed.groupBy("shard").count().select(F.col("shard").alias("_shard"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    # A row for each shard of trees fitted to a bounded sample: fewer than BANDS x SAMPLE rows of two numbers.
    dealt = placed.join(F.broadcast(sizes), F.col("shard") == F.col("_shard")).withColumn("own", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("shard", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")

    def compared(group: pd.DataFrame) -> pd.DataFrame:
        across = bool(group.i.iloc[0] != group.j.iloc[0])
        fps, own = group.fp.to_numpy().view("<u8"), group.own.to_numpy()
        if len(fps) < 2 or (across and len(np.unique(own)) < 2):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
        a, b = close_links(fps, own, across, distance)
        return pd.DataFrame({"a": a.view("<i8"), "b": b.view("<i8")})

    return dealt.groupBy("shard", "i", "j").applyInPandas(compared, "a long, b long")


def grouped(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """Adds to rows with doc_id and fp: component_id, the smallest doc_id reachable over links, and part, the least
    fingerprint of the component: its identity, as doc_ids may be null or repeated."""
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")))
    parts = components(close_fingerprints(distinct, distance))
    members = distinct.join(parts, distinct["fp"] == parts["node"], "left").withColumn("part", F.coalesce("least", "fp"))
    members = written(members.select("fp", "first", "n", "part"))
    least = members.groupBy("part").agg(F.min("first").alias("component_id"), F.count("*").alias("_fps"))
    by_fp = join_by_key(members, least, "part", "_fps")
    return join_by_key(prints, by_fp.select("fp", F.col("n").alias("_n"), "component_id", "part"), "fp", "_n").drop("_n")


def near_groups(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id."""
    out = grouped(written(fingerprints(docs)), distance)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """One row of each component, the one with the smallest doc_id, all columns; of repeated rows one stays."""
    prints = written(fingerprints(docs, [row_key(docs).alias("_row")]))
    kept = grouped(prints, distance).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("key"))
    return rows_with_key(docs, kept)
