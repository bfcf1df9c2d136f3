"""Repeated byte strings: remove every byte that lies in a string of `length` bytes which also starts elsewhere.

Suffixes are sampled, named, sorted and merged as in difference-cover suffix sorting, with one change: which suffixes
are sampled follows from the text, not from positions. Of the length - CORE + 1 cores (strings of CORE bytes) in a
string of `length` bytes the one with the least hash, leftmost among equals, is its anchor. Equal strings have their
anchors at equal offsets, which is what a difference cover is for: any two equal strings share a sampled position.
About one position in 85 is an anchor, where a cover by positions would need one in ten.

1. Each anchor stands for the run of strings (suffixes cut to `length` bytes) whose anchor it is. Its names are its
   core, and the triple (bytes before, core, bytes after) over the whole run. Names that occur once go no further.
2. Recursion on names: runs with equal triples are equal, so all their strings are repeated; runs that share the core
   but differ in the triple go on.
3. Remaining suffixes: of each distinct run of such a core the bytes are gathered by core, the strings within them are
   sorted by name, and adjacent ones compared. Very large groups are cut string by string instead.
4. The repeated ranges of a document are united and cut from its bytes.

Equality is judged by 128 bits of hashes. A task pre-aggregates its runs, so a passage in a third of all documents is a
row for each task. Defined cases: a null text has no bytes; texts shorter than `length` keep all; rows that repeat both
id and text are copies of each other like any others; an empty table gives no rows; extra columns are kept by
`deduplicated` and ignored by `removal_report`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tabscout.llm.common import documents_text, in_batches, join_by_key, values, written

LENGTH, CORE = 200, 32
# Bytes hashed at once; anchors aggregated at once in a task; runs compared at once; runs of a core beyond which its
# strings are compared as rows.
PIECE, FLUSH, BATCH, LARGE = 1 << 20, 400_000, 8_000, 100_000
PLACE_BITS = 30
TABLES = np.random.default_rng(20240102).integers(0, 2**63, (2, 256)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29), np.uint64(32))


def window_hashes(data: np.ndarray, width: int, table: int = 0) -> np.ndarray:
    """A 64-bit hash of each string of `width` bytes, from hashes of halves."""
    h, size = TABLES[table][data], 1

    def joined(step: int) -> np.ndarray:
        a = h[: len(h) - step] * MIX[0]
        a ^= a >> MIX[2]
        a += h[step:]
        a *= MIX[1]
        a ^= a >> MIX[3]
        return a

    while size * 2 <= width:
        h, size = joined(size), size * 2
    return joined(width - size) if size < width else h


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        keys, size = np.minimum(keys[: len(keys) - size], keys[size:]), size * 2
    step = width - size
    return np.minimum(keys[: len(keys) - step], keys[step:]) if step else keys


def runs_of(data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end (bounds: where each begins, and the end): text, anchor, first and last start of the
    strings of each run, and the core's hash."""
    none = np.zeros(0, dtype=np.int64)
    if len(data) < length:
        return none, none, none, none, none.astype(np.uint64)
    cores = window_hashes(data, CORE)
    places = np.arange(len(cores), dtype=np.uint64)
    keys = (cores >> np.uint64(PLACE_BITS) << np.uint64(PLACE_BITS)) | places
    anchors = (sliding_least(keys, length - CORE + 1) & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    counts = np.maximum(np.diff(bounds) - length + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    if not len(text):
        return none, none, none, none, none.astype(np.uint64)
    starts = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[:-1][text]
    anchors = anchors[starts]
    new = np.concatenate([[True], (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(starts)) - 1
    return text[first], anchors[first], starts[first], starts[last], cores[anchors[first]]


def pieces(texts: Iterator[tuple[tuple, bytes]], length: int) -> Iterator[tuple[list, list, bytes, np.ndarray]]:
    """Texts laid end to end in parts of about PIECE bytes: keys, offsets in the text, bytes, bounds. Longer texts are
    cut into parts that overlap by length - 1 bytes, so that every string lies in one part."""
    keys, offsets, parts, size = [], [], [], 0

    def laid():
        return keys, offsets, b"".join(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    for key, text in texts:
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at : at + PIECE + length - 1]
            if len(part) < length:
                continue
            keys.append(key)
            offsets.append(at)
            parts.append(part)
            size += len(part)
            if size >= PIECE:
                yield laid()
                keys, offsets, parts, size = [], [], [], 0
    if parts:
        yield laid()


RUNS = pa.schema([("core", pa.int64()), ("triple", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("anchor", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
RUNS_DDL = "core long, triple long, n long, h1 long, h2 long, anchor long, first long, last long"


def named_runs(texts: DataFrame, length: int) -> DataFrame:
    """texts: h1, h2, text. A row for each distinct run of a task, n being how often the task has it; and rows with
    n = 0, which need no more names: runs that the task holds at least twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def flushed() -> pa.RecordBatch:
            core, triple, h1, h2, anchor, first, last = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((triple, core))
            same = np.zeros(len(order), dtype=bool)
            same[1:] = (core[order][1:] == core[order][:-1]) & (triple[order][1:] == triple[order][:-1])
            head = np.nonzero(~same)[0]
            counts = np.diff(np.append(head, len(order)))
            again = np.repeat(counts, counts) > 1  # in sorted order
            rows = np.concatenate([order[head], order[again]])
            n = np.concatenate([counts, np.zeros(int(again.sum()), dtype=np.int64)])
            columns = [core[rows], triple[rows], n, h1[rows], h2[rows], anchor[rows], first[rows], last[rows]]
            return pa.record_batch([pa.array(c.astype(np.int64)) for c in columns], schema=RUNS)

        def texts_of():
            for h1, h2, text in values(batches, "h1", "h2", "text"):
                yield (h1, h2), text.encode()

        total = 0
        for keys, offsets, data, bounds in pieces(texts_of(), length):
            text, anchor, first, last, core = runs_of(np.frombuffer(data, dtype=np.uint8), bounds, length)
            triple = np.array([xxhash.xxh3_64_intdigest(data[f : e + length], seed=a - f) for a, f, e in zip(anchor.tolist(), first.tolist(), last.tolist())], dtype=np.uint64)
            shift = np.array(offsets, dtype=np.int64)[text] - bounds[:-1][text]
            both = np.array(keys, dtype=np.int64).reshape(-1, 2)[text]
            held.append([core.view(np.int64), triple.view(np.int64), both[:, 0], both[:, 1], anchor + shift, first + shift, last + shift])
            total += len(core)
            if total >= FLUSH:
                yield flushed()
                total = 0
        if held:
            yield flushed()

    return texts.select("h1", "h2", "text").mapInArrow(run, RUNS_DDL)


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with h1 and h2, two hashes of id and text that find a row's text again."""
    return docs.select(F.xxhash64(F.lit(1), docs["doc_id"], docs["text"]).alias("h1"), F.xxhash64(F.lit(2), docs["doc_id"], docs["text"]).alias("h2"), "doc_id", documents_text(docs).alias("text"))


def compressed(texts: DataFrame) -> DataFrame:
    """h1, h2, doc_id and the text's bytes compressed, for shuffles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = pa.array([packer.compress(t.encode()) for t in batch.column(3).to_pylist()], pa.binary())
            yield pa.record_batch([*batch.columns[:3], z], names=["h1", "h2", "doc_id", "z"])

    return texts.mapInArrow(run, "h1 long, h2 long, doc_id long, z binary")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """(h1, h2, first, last): starts of repeated strings, as ranges of bytes of the keyed rows."""
    texts = keyed(docs)
    runs = written(named_runs(texts, length))
    names = runs.filter("n > 0")
    # Level one: cores that occur twice or more. Level two: their triples.
    cores = names.groupBy("core").agg(F.count("*").alias("_rows"), F.sum("n").alias("_total"), (F.min("triple") != F.max("triple")).alias("mixed"))
    cores = written(cores.filter("_total >= 2"))
    kept = join_by_key(names, cores, "core", "_rows").filter(F.col("_total").isNotNull())
    # At most a place for each task and flush.
    place = F.struct("h1", "h2", "anchor", "first", "last")
    triples = written(kept.groupBy("core", "triple").agg(F.sum("n").alias("n"), F.first("mixed").alias("mixed"), F.first("_rows").alias("rows"), F.collect_list(place).alias("places")).filter("n >= 2 or mixed"))
    sure = triples.filter("n >= 2").select(F.explode("places").alias("p")).select("p.h1", "p.h2", "p.first", "p.last")
    sure = sure.union(runs.filter("n = 0").select("h1", "h2", "first", "last"))
    # A core that occurs once in all tasks but twice in one has its ranges above already.
    open_runs = triples.filter("mixed").select("core", (F.col("n") >= 2).alias("done"), (F.col("rows") > large).alias("large"), F.col("places")[0].alias("p"))
    lists = open_runs.groupBy("p.h1", "p.h2").agg(F.collect_list(F.struct("core", "done", "large", "p.anchor", "p.first", "p.last")).alias("runs"))
    gathered = compressed(texts).dropDuplicates(["h1", "h2"]).join(lists, ["h1", "h2"])
    strings = written(gathered.select("h1", "h2", "z", "runs").mapInArrow(lambda b: cut_runs(b, length), CUT_DDL))
    return sure.union(compared(strings.filter("not large"), length)).union(compared_one_by_one(strings.filter("large"), length))


CUT = pa.schema([("core", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int64()), ("done", pa.bool_()), ("large", pa.bool_()), ("bytes", pa.binary())])
CUT_DDL = "core long, h1 long, h2 long, first long, done boolean, large boolean, bytes binary"
RANGES = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("first", pa.int64()), ("last", pa.int64())])
RANGES_DDL = "h1 long, h2 long, first long, last long"


def cut_runs(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of each listed run of a document."""
    unpacker = zstandard.ZstdDecompressor()

    def rows():
        for h1, h2, z, runs in values(batches, "h1", "h2", "z", "runs"):
            data = unpacker.decompress(z)
            for r in runs:
                yield r["core"], h1, h2, r["first"], r["done"], r["large"], data[r["first"] : r["last"] + length]

    yield from in_batches(rows(), CUT)


def compared(strings: DataFrame, length: int) -> DataFrame:
    """Ranges of repeated strings in runs that share a core: a task sorts the strings of whole cores by name and
    compares adjacent ones."""

    def repeated(rows: list[tuple]) -> list[tuple]:
        data = np.frombuffer(b"".join(r[5] for r in rows), dtype=np.uint8)
        sizes = np.array([len(r[5]) for r in rows])
        counts = sizes - length + 1
        row = np.repeat(np.arange(len(rows)), counts)
        at = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
        where = np.repeat(np.cumsum(sizes) - sizes, counts) + at
        name, check = window_hashes(data, length)[where], window_hashes(data, length, 1)[where]
        order = np.argsort(name, kind="stable")
        same = (name[order][1:] == name[order][:-1]) & (check[order][1:] == check[order][:-1])
        twice = np.zeros(len(row), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice &= ~np.array([r[4] for r in rows])[row]
        found = np.nonzero(twice)[0]
        if not len(found):
            return []
        breaks = np.nonzero((np.diff(found) != 1) | (np.diff(row[found]) != 0))[0]
        heads, tails = found[np.concatenate([[0], breaks + 1])], found[np.append(breaks, len(found) - 1)]
        return [(rows[r][1], rows[r][2], rows[r][3] + a, rows[r][3] + b) for r, a, b in zip(row[heads].tolist(), at[heads].tolist(), at[tails].tolist())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            held: list[tuple] = []
            for row in values(batches, "core", "h1", "h2", "first", "done", "bytes"):
                if len(held) >= BATCH and row[0] != held[-1][0]:
                    yield from repeated(held)
                    held = []
                held.append(row)
            if held:
                yield from repeated(held)

        yield from in_batches(rows(), RANGES)

    tasks = int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = strings.select("core", "h1", "h2", "first", "done", "bytes").repartition(tasks, "core").sortWithinPartitions("core")
    return dealt.mapInArrow(run, RANGES_DDL)


def compared_one_by_one(strings: DataFrame, length: int) -> DataFrame:
    """The same for cores of very many runs, whose group no task should hold: a row for each string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h1, h2, first, done, data in values(batches, "h1", "h2", "first", "done", "bytes"):
            own = np.frombuffer(data, dtype=np.uint8)
            a, b = window_hashes(own, length), window_hashes(own, length, 1)
            k = len(a)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array([h1] * k, pa.int64()), pa.array([h2] * k, pa.int64()),
                                   pa.array(np.arange(first, first + k)), pa.array([done] * k)], names=["a", "b", "h1", "h2", "at", "done"])

    rows = strings.select("h1", "h2", "first", "done", "bytes").mapInArrow(run, "a long, b long, h1 long, h2 long, at long, done boolean")
    counts = rows.groupBy("a", "b").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.struct("a", "b").alias("name"), "_n")
    rows = rows.filter("not done").withColumn("name", F.struct("a", "b"))
    return join_by_key(rows, counts, "name", "_n").filter("_n > 1").select("h1", "h2", F.col("at").alias("first"), F.col("at").alias("last"))


def united(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by the strings of the ranges of starts, ends exclusive."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(ranges):
        if out and first <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], last + length)
        else:
            out.append((first, last + length))
    return out


def without(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for start, end in spans:
        parts.append(data[at:start])
        at = end
    return b"".join([*parts, data[at:]])


def by_document(docs: DataFrame, length: int, large: int) -> DataFrame:
    """h1, h2 and the list of repeated ranges; no row for texts without any."""
    ranges = repeated_ranges(docs, length, large)
    return ranges.groupBy("h1", "h2").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))


REPORT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])
REPORT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def removal_report(docs: DataFrame, length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (maximal removed runs) and the digest of what is left, for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()

        def rows():
            for doc_id, z, ranges in values(batches, "doc_id", "z", "ranges"):
                data = unpacker.decompress(z)
                spans = united([(r["first"], r["last"]) for r in ranges or ()], length)
                yield doc_id, len(data), sum(e - s for s, e in spans), len(spans), hashlib.sha256(without(data, spans)).hexdigest()

        yield from in_batches(rows(), REPORT)

    joined = compressed(keyed(docs)).join(by_document(docs, length, large), ["h1", "h2"], "left")
    return joined.select("doc_id", "z", "ranges").mapInArrow(run, REPORT_DDL)


def deduplicated(docs: DataFrame, length: int = LENGTH, large: int = LARGE) -> DataFrame:
    """The documents without their repeated bytes: the first of each set of equal strings goes as well, as in the
    report. Bytes of characters that are cut in half vanish; rows whose whole text is repeated keep an empty one."""
    names = docs.columns
    held = F.struct(*[docs[c] for c in names if c != "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, ranges in values(iter([batch]), "text", "ranges"):
                if text is None or not ranges:
                    out.append(text)
                else:
                    out.append(without(text.encode(), united([(r["first"], r["last"]) for r in ranges], length)).decode(errors="ignore"))
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string())], schema=pa.schema([batch.schema.field(0), ("text", pa.string())]))

    hashes = [F.xxhash64(F.lit(k), docs["doc_id"], docs["text"]).alias(f"h{k}") for k in (1, 2)]
    rows = docs.select(held.alias("held"), docs["text"], *hashes).join(by_document(docs, length, large), ["h1", "h2"], "left")
    rows = rows.select("held", "text", "ranges")
    schema = T.StructType([rows.schema["held"], T.StructField("text", T.StringType())])
    out = rows.mapInArrow(run, schema)
    n_chars = F.length("text").cast("long")
    return out.select(*[F.col("text") if c == "text" else n_chars.alias(c) if c == "n_chars" else F.col("held")[c].alias(c) for c in names])
