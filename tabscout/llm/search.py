"""Ranked lexical search by NRA: only sequential reads of impact-sorted lists, with an interval of scores per document.

The corpus is cut by documents: each task holds the lists of its own documents, a bounded chunk at a time. A list has the
documents of one term, largest impact first. Reading goes on in all open lists together; what has been read of a document
is the lower end of its score, and adding the next unread impact of every list that hasn't named it yet gives the upper
end. Documents whose upper end lies below the k-th lower end are out (at equality they stay, since ties are decided by
doc_id). A list closes when every document left has been read from it; the search ends when the intervals of all
documents left are single points, so membership, ties and scores are final. A task's k-th score so far is the bound that its
next chunk starts with. The tasks' best are ranked together in two steps, so no task gets the rows of an item from all others.

Items are searched in blocks whose terms are a bounded table that every task holds; for each block the corpus is read
once, and what its terms need is written: a document's number of terms, and its counts of the block's terms.

Defined cases: a null text has no term, and a document without terms counts nowhere; an item without terms, or with terms of
no document, has no rows; a repeated document row is a document of its own, equal scores of one doc_id follow each other; null
doc_ids come last among equal scores; a repeated item row is an item of its own. Whole texts of any length are read.
Other columns are ignored. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from tabscout.llm.common import documents_text, written

# Fixed values of the score.
WEIGHT, SCALE, FACTOR, SHARE = 1000, 1_000_000_000, 20, 50
BEST = 50
# Bytes of item texts in a block; postings and documents of a chunk; postings read of each list in the first round.
BLOCK_BYTES, CHUNK_POSTINGS, CHUNK_DOCUMENTS, DEPTH = 16 << 20, 1 << 20, 1 << 14, 256
# Parts of the tasks whose best are ranked before all.
PARTS = 256

# ASCII letters and digits and all bytes of other characters belong to terms, A-Z in lower case; the rest separates them.
FOLDED = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLDED).split()


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int | None, list[bytes]]]]:
    """(item_id, distinct terms) of all items, in blocks of bounded size."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), documents_text(items).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    count = math.ceil(size / BLOCK_BYTES)
    for block in range(count):
        held = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == block)
        yield [(r.item_id, sorted(set(terms_of(r.text)))) for r in held.toLocalIterator()]


def counted(docs: DataFrame, numbers: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms) and the counts of the numbered terms, of each document with a term."""
    held = docs.sparkSession.sparkContext.broadcast(numbers)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), documents_text(docs).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        for batch in batches:
            ids, sizes, terms, counts = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = terms_of(text)
                if found:
                    own = Counter(filter(None, map(known.get, found)))
                    ids.append(doc_id)
                    sizes.append(len(found))
                    terms.append(list(own))
                    counts.append(list(own.values()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "counts"])

    return rows.mapInArrow(run, "doc_id long, n long, terms array<int>, counts array<long>")


def lengths(n: np.ndarray, documents: int, tokens: int) -> np.ndarray:
    """m of the score, for documents of n terms."""
    if SHARE * int(n.max(initial=0)) * documents < 1 << 63:
        return 100 - SHARE + SHARE * n * documents // tokens
    return np.array([100 - SHARE + SHARE * int(x) * documents // tokens for x in n], dtype=np.int64)


class Lists:
    """The impact-sorted lists of a chunk of documents."""

    def __init__(self, doc_ids: pa.Array, document: np.ndarray, term: np.ndarray, impact: np.ndarray, terms: int):
        order = np.lexsort((document, -impact, term))
        order = order[impact[order] > 0]
        self.document, self.impact = document[order], impact[order]
        self.starts = np.searchsorted(term[order], np.arange(terms + 2))
        self.missing = np.asarray(doc_ids.is_null())
        self.doc_ids = np.asarray(doc_ids.fill_null(0))

    def search(self, terms: np.ndarray, best: int, bound: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
        """(document, score) of all documents that may be among the best: final scores of at least the bound."""
        at, end = self.starts[terms], self.starts[terms + 1]
        at, end = at[at < end], end[at < end]
        lower = np.zeros(len(self.doc_ids), dtype=np.int64)
        seen = np.zeros((len(at), len(lower)), dtype=bool)
        open_ = np.arange(len(at))
        while True:
            for k in open_:
                stop = min(at[k] + depth, end[k])
                found = self.document[at[k] : stop]
                lower[found] += self.impact[at[k] : stop]
                seen[k, found] = True
                at[k] = stop
            ahead = np.where(at < end, self.impact[np.minimum(at, end - 1)], 0)
            upper = lower + ahead.sum()
            for k in np.nonzero(ahead)[0]:
                upper[seen[k]] -= ahead[k]
            least = max(bound, 1)
            if len(lower) > best:
                least = max(least, int(np.partition(lower, len(lower) - best)[len(lower) - best]))
            left = np.nonzero(upper >= least)[0]
            if np.array_equal(lower[left], upper[left]):
                return left, lower[left]
            open_ = np.nonzero((ahead > 0) & ~seen[:, left].all(axis=1))[0]
            depth *= 2


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of counted() in tables of a bounded number of documents and postings; one document may exceed them."""
    held, size = [], 0
    for batch in batches:
        ends = np.asarray(batch.column(2).offsets)[1:]
        begin, base = 0, int(np.asarray(batch.column(2).offsets)[0])
        while begin < batch.num_rows:
            room = max(1, CHUNK_DOCUMENTS - sum(b.num_rows for b in held))
            stop = int(np.searchsorted(ends, base + CHUNK_POSTINGS - size, side="right"))
            stop = min(max(stop, begin + (not held)), begin + room, batch.num_rows)
            if stop > begin:
                held.append(batch.slice(begin, stop - begin))
                size += int(ends[stop - 1]) - base
                begin, base = stop, int(ends[stop - 1])
            if begin < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def search_block(docs: DataFrame, items: list[tuple[int | None, list[bytes]]], best: int) -> DataFrame:
    """item (its place in the block), item_id, doc_id, score: each task's best documents of each item."""
    spark = docs.sparkSession
    numbers = {t: k + 1 for k, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    rows = written(counted(docs, numbers))
    documents, tokens = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(numbers) + 1, dtype=np.int64)
    # A row for each term of the block's items.
    for term, df in rows.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        weights[term] = math.floor(WEIGHT * math.log((2 * documents + 2) / (2 * df + 1)))
    held = spark.sparkContext.broadcast((weights, [(item_id, np.array([numbers[t] for t in terms], dtype=np.int64)) for item_id, terms in items]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, wanted = held.value
        found: list[pa.Table | None] = [None] * len(wanted)
        bounds = [0] * len(wanted)
        for table in chunks(batches):
            table = table.combine_chunks()
            n, lists = np.asarray(table.column("n")), table.column("terms").combine_chunks()
            term, tf = np.asarray(lists.flatten()).astype(np.int64), np.asarray(table.column("counts").combine_chunks().flatten())
            document = np.repeat(np.arange(len(n)), np.diff(np.asarray(lists.offsets)))
            impact = weight[term] * (SCALE * tf // (1000 * tf + FACTOR * lengths(n, documents, tokens)[document]))
            index = Lists(table.column("doc_id").combine_chunks(), document, term, impact, len(weight) - 1)
            for k, (_, terms) in enumerate(wanted):
                own, score = index.search(terms, best, bounds[k])
                if not len(own):
                    continue
                more = pa.table({"doc_id": pa.array(index.doc_ids[own], mask=index.missing[own]), "score": score})
                more = more if found[k] is None else pa.concat_tables([found[k], more])
                order = more.sort_by([("score", "descending"), ("doc_id", "ascending")]).slice(0, best)
                found[k] = order
                if order.num_rows == best:
                    bounds[k] = order.column("score")[best - 1].as_py()
        for k, rows in enumerate(found):
            if rows is not None:
                size = rows.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * size, pa.int32()), pa.array([wanted[k][0]] * size, pa.int64()), rows.column("doc_id").combine_chunks(), rows.column("score").combine_chunks()],
                    names=["item", "item_id", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score of each item's best documents. docs: doc_id, text; items: item_id, text."""
    out = None
    for block, held in enumerate(item_blocks(items)):
        rows = search_block(docs, held, best).withColumn("block", F.lit(block))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # First within parts of the tasks, then among the best of the parts.
    first = out.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("block", "item", "part").orderBy(*order))).filter(F.col("rank") <= best)
    rank = F.row_number().over(Window.partitionBy("block", "item").orderBy(*order))
    return first.withColumn("rank", rank).filter(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")
