"""Vector code compression: parts of vectors become numbers of codebook entries, found by equal-average search.

Components become integers, a vector is cut into PARTS equal consecutive parts, and each part position has a codebook of
at most ENTRIES entries, taken from the smallest vec_ids and moved to the means of their parts in ROUNDS rounds. The search
keeps the entries sorted by component sum. Of two vectors of d components whose sums differ by g the squared
distance is at least g * g / d. So a part starts at its own sum and takes the next entry outward, on the side with the smaller gap,
until the squared gap over d exceeds the best distance strictly; entries at equality are still looked at, since ties go to the lower
index. Assigning is Arrow arithmetic in the tasks; a task sends one row of sums for each entry it used, and the
codebooks, bounded by their size, are all that reaches the driver.

Defined cases: rows without vec_id count as the largest vec_ids; equal vec_ids follow by the vector; repeated rows are vectors
of their own; an empty vector counts as null; labels may be null, null labels are one group; fewer vectors than ENTRIES give as many
entries; an empty table gives no rows. Vectors of different lengths, or of a length that PARTS doesn't divide, raise an
error. Components beyond the range in which all squares fit 64 bits (2 ** 26 after scaling, for parts of 16) are set to
its ends; a sum of errors beyond 64 bits is null. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tabscout.llm.common import join_by_key, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BLOCK = 4096


def largest_component(size: int) -> int:
    """The limit of components at which squared distances, squared gaps and distances times size fit 64 bits."""
    return 1 << (61 - 2 * (size - 1).bit_length()) // 2


def scaled_vectors(df: DataFrame) -> tuple[DataFrame, int]:
    """(rows, length): vec_id, label and the integer components of the rows with a vector."""
    vector = F.col("embedding")
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = df.select("vec_id", "label", F.transform(vector, lambda x: x.cast("double")).alias("vector")).filter(sound & (F.size(vector) > 0))
    least, length = rows.agg(F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if least is None:
        return rows, 0
    if least != length or length % PARTS:
        raise ValueError(f"vectors need one length that {PARTS} divides, not {least} to {length}")
    most = largest_component(length // PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).flatten()).reshape(-1, length)
            x = np.clip(np.floor(SCALE * x), -most, most).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(x), pa.list_(pa.int64()))], names=["vec_id", "label", "vector"])

    kinds = dict(df.dtypes)
    return written(rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, vector array<long>")), length


class Codebook:
    """The entries of one part position, sorted by component sum."""

    def __init__(self, entries: np.ndarray):
        sums = entries.sum(axis=1)
        self.order = np.argsort(sums, kind="stable")
        self.entries, self.sums = entries[self.order], sums[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of the nearest entry of each row; of equally near ones the lowest index."""
        size, far = x.shape[1], np.iinfo(np.int64).max
        index, best = np.full(len(x), len(self.order)), np.full(len(x), far)
        own = x.sum(axis=1)
        right = np.searchsorted(self.sums, own)
        left = right - 1
        # Rows still searching, with their state beside them.
        at = np.arange(len(x))
        while len(at):
            none = np.iinfo(np.int64).max
            below = np.where(left >= 0, own - self.sums[np.maximum(left, 0)], none)
            above = np.where(right < len(self.sums), self.sums[np.minimum(right, len(self.sums) - 1)] - own, none)
            gap = np.minimum(below, above)
            going = gap < none
            near = best[at]
            tried = near < far
            limited = going & tried
            going[limited] = gap[limited] * gap[limited] <= near[limited] * size
            if not going.all():
                at, own, left, right, below, above = (v[going] for v in (at, own, left, right, below, above))
                if not len(at):
                    break
            down = below <= above
            place = np.where(down, left, right)
            distance = x[at] - self.entries[place]
            distance = np.einsum("ij,ij->i", distance, distance)
            name = self.order[place]
            better = (distance < best[at]) | ((distance == best[at]) & (name < index[at]))
            best[at[better]], index[at[better]] = distance[better], name[better]
            left, right = left - down, right + ~down
        return index, best


def assigned(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """(indexes by part, squared distance over all parts) of rows of vectors."""
    size = x.shape[1] // PARTS
    names, error = np.empty((len(x), PARTS), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    for k in range(0, len(x), BLOCK):
        for part, book in enumerate(books):
            names[k : k + BLOCK, part], distance = book.nearest(x[k : k + BLOCK, part * size : (part + 1) * size])
            error[k : k + BLOCK] += distance
    return names, error


def vectors_of(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def first_codebooks(rows: DataFrame, length: int) -> np.ndarray:
    """[part, entry, position]: the parts of the vectors with the smallest vec_ids."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "vector").limit(ENTRIES).select("vector").collect()
    return np.array([r.vector for r in first], dtype=np.int64).reshape(-1, PARTS, length // PARTS).transpose(1, 0, 2).copy()


def moved(rows: DataFrame, entries: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry that is some part's nearest becomes the floor of their mean."""
    books = rows.sparkSession.sparkContext.broadcast([Codebook(e) for e in entries])
    _, count, size = entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, used = np.zeros(entries.shape, dtype=np.int64), np.zeros((PARTS, count), dtype=np.int64)
        for batch in batches:
            x = vectors_of(batch.column(0))
            names, _ = assigned(x, books.value)
            for part in range(PARTS):
                np.add.at(sums[part], names[:, part], x[:, part * size : (part + 1) * size])
                used[part] += np.bincount(names[:, part], minlength=count)
        own = np.nonzero(used.ravel())[0]
        yield pa.RecordBatch.from_arrays(
            [pa.array(own), pa.array(used.ravel()[own]), pa.array(list(sums.reshape(-1, size)[own]), pa.list_(pa.int64()))], names=["entry", "n", "sums"])

    found = rows.select("vector").mapInArrow(run, "entry long, n long, sums array<long>").groupBy("entry")
    found = found.agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[k]) for k in range(size))).alias("sums"))
    out = entries.reshape(-1, size).copy()
    for r in found.collect():  # one row for each of the PARTS * ENTRIES entries at most
        out[r.entry] = [s // r.n for s in r["sums"]]
    return out.reshape(entries.shape)


def trained_codebooks(rows: DataFrame, length: int, rounds: int = ROUNDS) -> np.ndarray:
    entries = first_codebooks(rows, length)
    for _ in range(rounds):
        entries = moved(rows, entries)
    return entries


def encode(rows: DataFrame, entries: np.ndarray) -> DataFrame:
    """vec_id, label, codes (the entries' indexes by part) and error of each row."""
    books = rows.sparkSession.sparkContext.broadcast([Codebook(e) for e in entries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, error = assigned(vectors_of(batch.column(2)), books.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(list(names), pa.list_(pa.int64())), pa.array(error)], names=["vec_id", "label", "codes", "error"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, codes array<long>, error long")


def compressed(df: DataFrame) -> DataFrame:
    """vec_id, code (two hexadecimal digits for each part), error, label_error (the errors of all rows with an equal label),
    codebooks_sha256. df: vec_id, embedding (an array of numbers), label."""
    rows, length = scaled_vectors(df)
    if not length:
        kind = dict(df.dtypes)["vec_id"]
        return df.sparkSession.createDataFrame([], f"vec_id {kind}, code string, error long, label_error long, codebooks_sha256 string")
    entries = trained_codebooks(rows, length)
    digest = hashlib.sha256(",".join(map(str, entries.ravel().tolist())).encode()).hexdigest()
    coded = written(encode(rows, entries))
    labels = coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("_n"))
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return join_by_key(coded, labels, "label", "_n").select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
