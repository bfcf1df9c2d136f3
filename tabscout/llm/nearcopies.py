"""Near copies by the Jaccard similarity of word shingles: one document stays of those that similarities of at least
SIMILAR connect.

Documents with equal sets of shingles are one point. Points that agree in a band of MinHash values are candidates: of
pairs at similarity 0.8 the BANDS bands of ROWS values miss seven in ten thousand. A bit of 128 of the values makes a sketch
that drops far pairs (at 0.8 the limit lies six deviations off), and the rest are compared exactly by their sets. The vantage-point
trees of `simhash` over the texts' fingerprints propose further pairs, of at most four differing bits, which are compared by their sets too. Each
bucket's points are first compared with its central point, the one whose buckets are largest: of copies of one text that is
mostly the text. Points that this leaves apart from most of their bucket are then compared with all of it, in
tasks of bounded size that return a link for each two parts they unite, never a row per pair.

Defined cases: a text of fewer than WORDS words is one shingle, a null or empty one has none and equals any other such
text; repeated rows are one; of equal ids the row whose key is least stays; very long texts are points like any other, in
a task of their own if need be; other columns, of any name, are kept. An empty table gives no rows. The columns lang and source
are needed, as they are part of a row's key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tabscout.llm.common import documents_text, join_by_key, written
from tabscout.llm.graph import components
from tabscout.llm.rules import row_key, rows_with_key
from tabscout.llm.simhash import close_fingerprints, fingerprint, local_labels

WORDS, ROWS, BANDS, SKETCH = 5, 6, 24, 36
# Points of a block, shingles of its sets, and distinct shingles that are counted at once.
BLOCK, BLOCK_SHINGLES, COLUMNS = 512, 1 << 20, 4096
# Sets up to this many shingles may be broadcast: at most a thousand of them, so 80 MB.
BROADCAST_SHINGLES = 10_000
# Shared shingles times NINE against the sizes' sum times FOUR: a similarity of 0.8 without fractions.
NINE, FOUR = 9, 4
_rng = np.random.default_rng(17)
FACTORS = _rng.integers(0, 1 << 31, ROWS * BANDS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
MASKS = _rng.integers(0, 1 << 32, ROWS * BANDS, dtype=np.uint32)
MIX, STEP = np.uint64(0x9E3779B97F4A7C15), 4096


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str) -> np.ndarray:
    """Sorted distinct hashes of the shingles; words with A-Z in lower case, as for fingerprints."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    known: dict[bytes, int] = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    own = np.array([known[w] for w in words], dtype=np.uint64)
    length = min(WORDS, len(own))
    out = np.full(len(own) - length + 1, length, dtype=np.uint64)
    for k in range(length):
        out = mixed(out * MIX + own[k : len(own) - length + 1 + k])
    return np.unique(out)


def signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bands' keys and the sketch of 128 bits."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(ROWS * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(low), STEP):
        part = (low[k : k + STEP, None] ^ MASKS) * FACTORS
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(least, part.min(axis=0), out=least)
    wide = mixed(least.astype(np.uint64) + MIX)
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in wide.reshape(BANDS, ROWS).T:
        keys = mixed(keys * MIX + column)
    return keys, np.packbits((wide[:128] & np.uint64(1)).astype(np.uint8)).view("<u8")


def points(docs: DataFrame) -> DataFrame:
    """doc_id, _row, the point's id and size, band keys, sketch and fingerprint of each document."""
    rows = docs.select("doc_id", row_key(docs).alias("_row"), documents_text(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, keys, sketches, prints = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                found = shingle_set(text)
                ids.append(xxhash.xxh64_intdigest(found.tobytes()))
                sizes.append(len(found))
                own, sketch = signature(found)
                keys.append(own.view("<i8"))
                sketches.append(sketch.view("<i8"))
                prints.append(fingerprint(text))
            both = np.array(sketches, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(np.array(ids, dtype="<u8").view("<i8")), pa.array(sizes, pa.int64()),
                pa.array(keys, pa.list_(pa.int64())), pa.array(both[:, 0]), pa.array(both[:, 1]),
                pa.array(np.array(prints, dtype="<u8").view("<i8"))], names=["doc_id", "_row", "id", "size", "keys", "s", "t", "fp"])

    return rows.mapInArrow(run, "doc_id long, _row struct<a: long, b: long>, id long, size long, keys array<long>, s long, t long, fp long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, shingles) of the wanted points. wanted: id and the key of one row that has it."""
    texts = docs.select(row_key(docs).alias("_row"), documents_text(docs).alias("text"))
    texts = texts.join(wanted.select(F.col("_row").alias("_wanted"), "id"), F.col("_row") == F.col("_wanted")).select("id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t).view("<i8") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"])

    # A row that occurs repeatedly is found repeatedly.
    return texts.dropDuplicates(["id"]).mapInArrow(run, "id long, shingles array<long>")


def may_be_close(a: str, b: str) -> Column:
    """Whether sizes and sketches allow for a similarity of 0.8."""
    size_a, size_b = F.col(f"{a}size"), F.col(f"{b}size")
    apart = F.bit_count(F.col(f"{a}s").bitwiseXOR(F.col(f"{b}s"))) + F.bit_count(F.col(f"{a}t").bitwiseXOR(F.col(f"{b}t")))
    return (5 * F.least(size_a, size_b) >= 4 * F.greatest(size_a, size_b)) & (apart <= SKETCH)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of similarity 0.8 or more. A point in very many pairs is broadcast with its set, unless that is large."""
    out = pairs
    for side in ("a", "b"):
        counts = pairs.groupBy(F.col(side).alias("_id")).agg(F.count("*").alias(f"_n{side}"))
        right = sets.join(counts, F.col("id") == F.col("_id")).select(F.col("id").alias(side), F.col("shingles").alias(f"_{side}"), f"_n{side}")
        out = join_by_key(out, right, side, f"_n{side}", F.size(f"_{side}") <= BROADCAST_SHINGLES).drop(f"_n{side}")
    shared = F.size(F.array_intersect("_a", "_b"))
    return out.filter(NINE * shared >= FOUR * (F.size("_a") + F.size("_b"))).select("a", "b")


def ordered(pairs: DataFrame, a: str, b: str) -> DataFrame:
    return pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share: products of 0/1 matrices, some columns at a time."""
    out = np.zeros((len(left), len(right)))
    sides = [np.concatenate(s) if s else np.zeros(0, dtype=np.int64) for s in (left, right)]
    common = np.intersect1d(*(np.unique(s) for s in sides), assume_unique=True)
    if not len(common):
        return out
    places = []
    for sets, values in zip((left, right), sides):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        place = np.minimum(np.searchsorted(common, values), len(common) - 1)
        known = common[place] == values
        places.append((owner[known], place[known], len(sets)))
    for k in range(0, len(common), COLUMNS):
        matrices = []
        for owner, place, size in places:
            own = (place >= k) & (place < k + COLUMNS)
            matrix = np.zeros((size, min(COLUMNS, len(common) - k)), dtype=np.float32)
            matrix[owner[own], place[own] - k] = 1
            matrices.append(matrix)
        out += matrices[0] @ matrices[1].T
    return out


def united(group: pd.DataFrame) -> pd.DataFrame:
    """Links (a, b) that connect what similar pairs of an open and any point of the group connect, one for each two parts united."""
    none = pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="int64")})
    sides = [group[group.open], group[~group.open]]
    parts, sizes = ([s[c].to_numpy() for s in sides] for c in ("part", "size"))
    near = parts[0][:, None] != parts[1][None, :]
    near &= 5 * np.minimum.outer(*sizes) >= 4 * np.maximum.outer(*sizes)
    apart = sum(np.bitwise_count(sides[0][c].to_numpy().view("<u8")[:, None] ^ sides[1][c].to_numpy().view("<u8")[None, :]).astype(np.int16) for c in ("s", "t"))
    near &= apart <= SKETCH
    rows, columns = np.nonzero(near.any(axis=1))[0], np.nonzero(near.any(axis=0))[0]
    if not len(rows):
        return none
    sets = [[np.asarray(v) for v in side.shingles.to_numpy()[own]] for side, own in zip(sides, (rows, columns))]
    shared = shared_counts(*sets)
    similar = near[np.ix_(rows, columns)] & (NINE * shared >= FOUR * (sizes[0][rows][:, None] + sizes[1][columns][None, :]))
    i, j = (own[k] for own, k in zip((rows, columns), np.nonzero(similar)))
    known, place = np.unique(np.concatenate([parts[0], parts[1]]), return_inverse=True)
    of_open, of_any = place[: len(parts[0])], place[len(parts[0]) :]
    labels = local_labels(of_open[i], of_any[j], np.arange(len(known)))
    moved = np.nonzero(labels != np.arange(len(known)))[0]
    return pd.DataFrame({"a": known[moved], "b": known[labels[moved]]})


def open_links(members: DataFrame, parts: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of points that are apart from most of their bucket: blocks of them against blocks of all its points."""
    placed = members.join(parts, F.col("id") == F.col("_node"), "left")
    placed = written(placed.select("key", "id", "size", "s", "t", F.coalesce("least", "id").alias("part")))
    by_part = placed.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("size").alias("shingles"))
    main = by_part.groupBy("key").agg(
        F.max_by("part", F.struct("n", -F.col("part"))).alias("main"), F.max(F.struct("n", -F.col("part"), "shingles"))["shingles"].alias("main_shingles"),
        F.max("n").alias("main_n"), F.sum("n").alias("_n"), F.sum("shingles").alias("shingles")).filter(F.col("_n") > F.col("main_n"))
    blocks = lambda n, shingles: F.greatest(F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")
    main = main.select("key", "main", "_n", blocks(F.col("_n"), F.col("shingles")).alias("all_blocks"),
                       blocks(F.col("_n") - F.col("main_n"), F.col("shingles") - F.col("main_shingles")).alias("open_blocks"))
    placed = written(join_by_key(placed, written(main), "key", "_n").filter(F.col("main").isNotNull()).drop("_n"))
    placed = placed.join(sets.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id")).drop("_id")
    sides = []
    for is_open, own, other in ((True, "open_blocks", "all_blocks"), (False, "all_blocks", "open_blocks")):
        side = placed.filter(F.col("part") != F.col("main")) if is_open else placed
        side = side.withColumn("own", F.pmod(F.xxhash64("id"), own).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        i, j = ("own", "other") if is_open else ("other", "own")
        sides.append(side.select("key", F.col(i).alias("i"), F.col(j).alias("j"), F.lit(is_open).alias("open"), "id", "size", "s", "t", "part", "shingles"))
    return sides[0].unionByName(sides[1]).groupBy("key", "i", "j").applyInPandas(united, "a long, b long")


def similar_links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of similar points. found: points(), written."""
    one = found.groupBy("id").agg(F.min("_row").alias("_row"), *(F.first(c).alias(c) for c in ("size", "keys", "s", "t")))
    placed = written(one).select(F.explode("keys").alias("key"), "id", "_row", "size", "s", "t")
    shared = written(placed.groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1"))
    members = written(join_by_key(placed, shared.withColumn("_known", F.lit(True)), "key", "_n").filter("_known").drop("_known"))
    weighed = members.groupBy(F.col("id").alias("_id")).agg(F.sum("_n").alias("score"), F.min("_row").alias("_wanted"))
    weighed = written(weighed)
    sets = written(sets_of(docs, weighed.select(F.col("_id").alias("id"), F.col("_wanted").alias("_row"))))

    # Each bucket's points with its central one.
    members = written(members.join(weighed.select("_id", "score"), F.col("id") == F.col("_id")).select("key", "id", "size", "s", "t", "score", "_n"))
    central = members.groupBy("key").agg(
        F.max_by(F.struct(F.col("id").alias("_central"), F.col("size").alias("_size"), F.col("s").alias("_s"), F.col("t").alias("_t")), F.struct("score", -F.col("id"))).alias("c"),
        F.count("*").alias("_members")).select("key", "c.*", "_members")
    first = join_by_key(members, central, "key", "_members").filter((F.col("id") != F.col("_central")) & may_be_close("", "_"))
    links = written(verified(written(ordered(first, "id", "_central")), sets))
    parts = written(components(links).select(F.col("node").alias("_node"), "least"))
    return links.unionByName(open_links(members, parts, sets))


def fingerprint_links(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The similar ones of the pairs (a, b) that the vantage-point trees of `simhash` propose: a point with the least one of its
    fingerprint, and those of two fingerprints a shard links. found: points(), written."""
    own = written(found.select("id", "fp").distinct())
    by_fp = written(own.groupBy("fp").agg(F.min("id").alias("_first"), F.count("*").alias("_n")))
    near = written(close_fingerprints(by_fp.select("fp")).distinct())
    pairs = join_by_key(own, by_fp, "fp", "_n").select(F.col("id").alias("a"), F.col("_first").alias("b"))
    for side, name in (("a", "_a"), ("b", "_b")):
        counts = near.groupBy(F.col(side).alias("_fp")).agg(F.count("*").alias(f"_n{side}"))
        ends = by_fp.join(counts, F.col("fp") == F.col("_fp")).select(F.col("fp").alias(side), F.col("_first").alias(name), f"_n{side}")
        near = join_by_key(near, ends, side, f"_n{side}").drop(f"_n{side}")
    pairs = written(ordered(pairs.union(near.select("_a", "_b")).filter(F.col("a") != F.col("b")), "a", "b"))
    wanted = pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct()
    rows = found.groupBy("id").agg(F.min("_row").alias("_row"))
    return verified(pairs, written(sets_of(docs, rows.join(wanted, F.col("id") == F.col("_id")).select("id", "_row"))))


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each part, the one with the smallest doc_id, all columns; of repeated rows one stays."""
    found = written(points(docs))
    parts = components(similar_links(docs, found).unionByName(fingerprint_links(docs, found)))
    best = found.groupBy("id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row")).alias("best"))
    best = best.join(parts, F.col("id") == F.col("node"), "left").withColumn("part", F.coalesce("least", "id"))
    kept = best.groupBy("part").agg(F.min("best")["_row"].alias("key"))
    return rows_with_key(docs, kept)
