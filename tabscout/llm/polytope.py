"""Embedding near-duplicates: cross-polytope hashing after fast Hadamard rotations.

Vectors of one label that are equal are one node. A node is scaled to length one, turned by three rounds of random signs and
Hadamard transforms, and hashed to the nearest vertex of the cross-polytope, that is its largest component and that one's
sign; a bucket is a run of such vertices. Each table keeps a node in its PROBES best buckets, which differ from the first
in the vertices that are nearly as close. Buckets have one more vertex where a label would fill them beyond BUCKET; the
tables are as many as pairs at the wanted cosine need to miss each other in all of them with odds of at most MISS, taken from
trials with random pairs of that cosine and dimension. All members of a bucket are compared by cosine in doubles, a
bucket beyond BLOCK in blocks, two at a time. A pair counts in the first of the buckets that hold both, so links are counted
once; what leaves a task is a row for each linked node, never a pair: the number of its links and a link to the
least node it is connected with there. Components of those links are joined across buckets.

Defined cases: a vector that is null, empty, zero or holds null or non-finite components, or has no label, links with
nothing; vectors of different lengths don't link; rows with equal vectors (repeated rows too) link with each other, each row a
vector of its own; ids that are null are no component's smallest unless all of them are, and then component_id is
null; kept is true where vec_id equals component_id, null ids included. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tabscout.llm.common import join_by_key, written
from tabscout.llm.graph import components
from tabscout.llm.simhash import local_labels
from tabscout.operators.joins import join_small

COSINE = 0.93
PROBES, ROUNDS, BUCKET, BLOCK, STEP = 4, 3, 2048, 4096, 512
MISS, TRIALS, MOST_TABLES = 0.001, 4000, 255


def hadamard(x: np.ndarray) -> np.ndarray:
    """The rows times the orthogonal Hadamard matrix; their length is a power of two."""
    n, size = x.shape
    half = 1
    while half < size:
        pairs = x.reshape(n, size // (2 * half), 2, half)
        x = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), axis=2).reshape(n, size)
        half *= 2
    return x / math.sqrt(size)


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def width_of(size: int) -> int:
    """The power of two that vectors of so many components are filled up to; few dimensions have few rotations."""
    return 1 << max(4, (size - 1).bit_length())


def probe_codes(x: np.ndarray, table: int, vertices: int) -> np.ndarray:
    """The best buckets of each unit vector in a table, nearest first: numbers below (2 * width) ** vertices."""
    width = width_of(x.shape[1])
    probes = min(PROBES, width)
    x = np.pad(x, ((0, 0), (0, width - x.shape[1])))
    codes, cost = np.zeros((len(x), 1), dtype=np.int64), np.zeros((len(x), 1))
    for k in range(vertices):
        signs = np.random.default_rng((table, k, width)).choice([-1.0, 1.0], (ROUNDS, width))
        turned = x
        for flips in signs:
            turned = hadamard(turned * flips)
        size = np.abs(turned)
        near = np.argsort(-size, axis=1, kind="stable")[:, :probes]
        height = np.take_along_axis(size, near, 1)
        vertex = 2 * near + (np.take_along_axis(turned, near, 1) < 0)
        codes = (codes[:, :, None] * (2 * width) + vertex[:, None, :]).reshape(len(x), -1)
        cost = (cost[:, :, None] + (height[:, :1] - height)[:, None, :] ** 2).reshape(len(x), -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        codes, cost = np.take_along_axis(codes, best, 1), np.take_along_axis(cost, best, 1)
    return codes


def needed_tables(size: int, vertices: int, cosine: float) -> int:
    """Tables with which a pair at the cosine is missed with odds of at most MISS, by random pairs of that cosine."""
    rng = np.random.default_rng(size)
    a = unit(rng.standard_normal((TRIALS, size)))
    side = rng.standard_normal((TRIALS, size))
    side -= (a * side).sum(axis=1, keepdims=True) * a
    length = np.linalg.norm(side, axis=1, keepdims=True)
    b = cosine * a + math.sqrt(max(0.0, 1 - cosine * cosine)) * side / np.where(length > 0, length, 1)
    met = np.zeros(TRIALS, dtype=bool)
    for table in range(MOST_TABLES):
        met |= (probe_codes(a, table, vertices)[:, :, None] == probe_codes(b, table, vertices)[:, None, :]).any(axis=(1, 2))
        if (~met).mean() <= MISS:
            break
    return table + 1


def comparable(df: DataFrame) -> Column:
    """Whether a row has a label and a vector with a direction."""
    vector = F.col("embedding")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col("label").isNotNull() & (F.size(vector) > 0) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def node_rows(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, nodes): vec_id and node of every row, null where it links with nothing; node, label, vector, first (its
    smallest vec_id) and n (its rows) of every distinct vector of a label."""
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))
    rows = df.select("vec_id", "label", F.when(comparable(df), plain).alias("vector"))
    for seed in range(100):
        key = F.when(F.col("vector").isNotNull(), F.xxhash64(F.lit(seed), "label", "vector")).alias("node")
        nodes = written(rows.filter(F.col("vector").isNotNull()).groupBy("label", "vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).select(key, "*"))
        # A node's number is a hash; of all numbers of a seed no two may be equal.
        if nodes.groupBy("node").count().filter(F.col("count") > 1).isEmpty():
            return written(rows.select("vec_id", key)), nodes
    raise ValueError("no seed gives distinct node numbers")


def hashed(nodes: DataFrame, cosine: float) -> DataFrame:
    """node, label, n, vector (doubles of length one, as bytes), size and the sorted numbers of its buckets in all tables."""
    largest = {r.size: r.n for r in nodes.groupBy("label", F.size("vector").alias("size")).count().groupBy("size").agg(F.max("count").alias("n")).collect()}
    plan = {}
    for size, n in largest.items():
        corners, vertices = 2 * width_of(size), 1
        while n * PROBES > BUCKET * corners**vertices and corners ** (vertices + 2) < 1 << 52:
            vertices += 1
        plan[size] = (corners, vertices, needed_tables(size, vertices, cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            sizes, flat, offsets = np.diff(np.asarray(lists.offsets)), np.asarray(lists.values), np.asarray(lists.offsets)
            for size in np.unique(sizes):
                own = np.nonzero(sizes == size)[0]
                corners, vertices, tables = plan[int(size)]
                x = unit(flat[offsets[own][:, None] + np.arange(size)])
                keys = np.hstack([table * corners**vertices + np.sort(probe_codes(x, table, vertices), axis=1) for table in range(tables)])
                part = batch.take(pa.array(own))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array([v.tobytes() for v in x], pa.binary()), pa.array(np.full(len(own), size, dtype=np.int32)), pa.array(list(keys), pa.list_(pa.int64()))],
                    names=["node", "label", "n", "vector", "size", "keys"])

    label = dict(nodes.dtypes)["label"]
    return nodes.select("node", "label", "n", "vector").mapInArrow(run, f"node long, label {label}, n long, vector binary, size int, keys array<long>")


def bucket_links(group: pd.DataFrame, bucket: int, cosine: float) -> pd.DataFrame:
    """node, least, links: of each node of the bucket (or of two of its blocks) its links that count here."""
    group = group.sort_values("node", ignore_index=True)
    x = np.frombuffer(b"".join(group.vector), dtype=np.float64).reshape(len(group), -1)
    keys, weight, node = np.array(group["keys"].tolist(), dtype=np.int64), group.n.to_numpy(), group.node.to_numpy()
    across = group.i.iloc[0] != group.j.iloc[0]
    rows = columns = np.arange(len(group))
    if across:
        first = (group.own == group.i).to_numpy()
        rows, columns = np.nonzero(first)[0], np.nonzero(~first)[0]
    probes = min(PROBES, width_of(x.shape[1]))
    table = int(np.argmax(keys[0] == bucket)) // probes
    labels, links = np.arange(len(group)), np.zeros(len(group), dtype=np.int64)
    for k in range(0, len(rows), STEP):
        part = rows[k : k + STEP]
        a, b = np.nonzero(x[part] @ x[columns].T >= cosine)
        a, b = part[a], columns[b]
        if not across:
            a, b = a[a < b], b[a < b]
        # Pairs that an earlier bucket holds too are counted there; only tables up to this one have such buckets.
        for t in range(0, (table + 1) * probes, probes):
            of_a, of_b = keys[a, t : t + probes], keys[b, t : t + probes]
            both = ((of_a[:, :, None] == of_b[:, None, :]).any(axis=2) & (of_a < bucket)).any(axis=1)
            a, b = a[~both], b[~both]
        links += np.bincount(a, weight[b], len(links)).astype(np.int64) + np.bincount(b, weight[a], len(links)).astype(np.int64)
        labels = local_labels(a, b, labels)
    found = np.nonzero(links)[0]
    return pd.DataFrame({"node": node[found], "least": node[labels[found]], "links": links[found]})


def node_links(nodes: DataFrame, cosine: float) -> DataFrame:
    """node, least, links: rows whose links add up to a node's links to other nodes, and whose pairs (node, least) connect
    what links connect."""
    placed = written(hashed(nodes, cosine)).withColumn("bucket", F.explode("keys"))
    bucket = ["label", "size", "bucket"]
    large = placed.groupBy(*bucket).count().filter(F.col("count") > BLOCK).withColumn("blocks", F.ceil(F.col("count") / BLOCK).cast("int")).drop("count")
    dealt = join_small(placed, written(large), bucket, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("blocks", "other")
    nothing = pd.DataFrame({c: pd.Series(dtype="int64") for c in ("node", "least", "links")})

    def compared(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        return bucket_links(group, int(key[2]), cosine) if len(group) > 1 else nothing

    return dealt.groupBy(*bucket, "i", "j").applyInPandas(compared, "node long, least long, links long")


def near_vectors(df: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links (other rows linked directly), component_id (smallest vec_id reachable), kept. df: vec_id, embedding
    (an array of numbers), label."""
    rows, nodes = node_rows(df)
    found = written(node_links(nodes, cosine))
    counts = found.groupBy(F.col("node").alias("_node")).agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("node").alias("a"), F.col("least").alias("b"))).withColumnRenamed("node", "_part_node")
    members = nodes.join(counts, F.col("node") == F.col("_node"), "left").join(parts, F.col("node") == F.col("_part_node"), "left")
    members = written(members.select("node", "first", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("least", "node").alias("part")))
    least = members.groupBy("part").agg(F.min("first").alias("component_id"), F.count("*").alias("_nodes"))
    by_node = join_by_key(members, least, "part", "_nodes").select("node", "n", "n_links", "component_id")
    linked = join_by_key(rows.filter(F.col("node").isNotNull()), by_node, "node", "n").select("vec_id", "n_links", "component_id")
    alone = rows.filter(F.col("node").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
