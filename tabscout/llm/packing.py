"""Packing documents into sequences along a space-filling curve.

A document's token ids are counted into hashed buckets; the normalised count vector is projected to a few dimensions,
and its Hilbert index is the sort key. Documents are range-partitioned and sorted by (key, doc_id), and each partition
cuts its stream of ids into sequences. What is left at a partition's end is cut into lengths that are powers of two,
which need no padding.

Defined cases: a null or empty text is the end id alone; long documents span as many sequences as they need; equal
documents have one key and lie side by side, ordered by doc_id; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tabscout.llm.common import documents_text, in_batches, values, written

LENGTH = 2048
END_ID = 1
DIMENSIONS, BITS, BUCKETS, SEED = 4, 15, 1024, 20240101
CACHE_WORDS = 1_000_000
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
TOKENS = pa.schema([("doc_id", pa.int64()), ("curve", pa.int64()), ("n", pa.int64()), ("ids", pa.binary())])
TOKENS_DDL = "doc_id long, curve long, n long, ids binary"
PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])
PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Words:
    """Ids of texts, word by word: the tokenizer drops white space and never merges across it, so that words between
    blanks can be looked up. Of new words, letters and the punctuation after them are tokens of their own, and the
    tokenizer lowers case, so that "Word," is "word" and ","."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = "<u2" if size < 1 << 16 else "<u4"
        self.ends_word = np.array([(self.tokenizer.id_to_token(k) or "").endswith("</w>") for k in range(size)])
        self.cache: dict[str, bytes] = {"": b""}

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        split = [t.replace("\n", " ").split(" ") for t in texts]
        cache = self.cache
        if len(cache) > CACHE_WORDS:
            cache.clear()
            cache[""] = b""
        self.learn(set().union(*split).difference(cache))
        return [np.frombuffer(b"".join(map(cache.__getitem__, words)), dtype=self.width) for words in split]

    def learn(self, new: set[str]) -> None:
        cache, parts, whole = self.cache, {}, []
        for word in new:
            letters = word.rstrip(PUNCTUATION)
            # Below U+0250 lower case is a matter of single letters, as the tokenizer takes it.
            if letters.isalpha() and (letters.isascii() or (max(letters) < "\u0250" and letters.lower().isalpha())):
                parts[word] = letters.lower(), word[len(letters) :]
            else:
                whole.append(word)
        self.learn_letters(list({low for low, _ in parts.values() if low not in cache}))
        self.learn_whole([*whole, *({tail for _, tail in parts.values()}.difference(cache))])
        for word, (low, tail) in parts.items():
            cache[word] = cache[low] + cache[tail]

    def learn_whole(self, words: list[str]) -> None:
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            for word, found in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)):
                self.cache[word] = np.array(found.ids, dtype=self.width).tobytes()

    def learn_letters(self, words: list[str]) -> None:
        """Words of letters alone, many in one text: each ends with a token that ends words."""
        for k in range(0, len(words), 10_000):
            part = words[k : k + 10_000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, dtype=self.width)
            ends = (np.nonzero(self.ends_word[ids])[0] + 1) * ids.itemsize
            if len(ends) != len(part):
                self.learn_whole(part)
                continue
            data, start = ids.tobytes(), 0
            for word, end in zip(part, ends.tolist()):
                self.cache[word] = data[start:end]
                start = end


@lru_cache(maxsize=2)
def words_of(path: str) -> Words:
    return Words(path)


@lru_cache(maxsize=1)
def projection() -> np.ndarray:
    """A row for each hash bucket: unit-length columns of a fixed random matrix."""
    drawn = np.random.default_rng(SEED).standard_normal((BUCKETS, DIMENSIONS))
    return drawn / np.linalg.norm(drawn, axis=0)


def coordinates(ids: np.ndarray) -> np.ndarray:
    """Whole numbers of BITS bits: the projected unit vector of a document's hashed token counts."""
    bucket = (ids.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(22)) % BUCKETS
    counts = np.bincount(bucket, minlength=BUCKETS).astype(np.float64)
    norm = np.linalg.norm(counts)
    place = (counts / norm if norm else counts) @ projection()
    return np.clip((place + 1) * 2 ** (BITS - 1), 0, 2**BITS - 1).astype(np.int64)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of whole numbers below 2**bits: undo the excess turns bit by bit, Gray-encode, and
    interleave the bits of the axes."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for i in range(n):
            turned = (x[i] & bit) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(turned, below, swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = out << 1 | (x[i] >> b & 1)
    return out


def tokenised(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, curve (Hilbert key), n (ids with the end id) and ids (little-endian, deflated)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(tokenizer_path)
        for batch in batches:
            for part in (batch.slice(k, 500) for k in range(0, batch.num_rows, 500)):
                found = words.ids(part.column(1).to_pylist())
                keys = hilbert(np.array([coordinates(ids) for ids in found])).tolist()
                packed = [zlib.compress(np.append(ids, np.array([END_ID], dtype=ids.dtype)).tobytes(), 1) for ids in found]
                yield pa.record_batch([part.column(0), pa.array(keys, pa.int64()), pa.array([len(i) + 1 for i in found], pa.int64()), pa.array(packed, pa.binary())], schema=TOKENS)

    return docs.select("doc_id", documents_text(docs).alias("text")).mapInArrow(run, TOKENS_DDL)


def powers(n: int) -> list[int]:
    """The powers of two whose sum is n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, tasks: int | None = None) -> DataFrame:
    """A row for each piece of a document in a sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset. The ids of all documents are written once, so that sorting by range does not encode them again."""
    tasks = tasks or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = written(tokenised(docs, tokenizer_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = words_of(tokenizer_path).width

        def closed(held: list[tuple], sequence: int, sizes: list[int]) -> Iterator[tuple]:
            """Pieces of the held ids, cut into sequences of the given sizes."""
            room = iter(sizes)
            left, offset = next(room), 0
            for doc_id, start, ids, total in held:
                at = 0
                while at < len(ids):
                    if not left:
                        left, offset, sequence = next(room), 0, sequence + 1
                    part = ids[at : at + left]
                    yield doc_id, start + at, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, sequence, offset
                    at, left, offset = at + len(part), left - len(part), offset + len(part)

        def rows():
            sequence = TaskContext.get().partitionId() << 40
            held, filled = [], 0
            for doc_id, total, packed in values(batches, "doc_id", "n", "ids"):
                ids = np.frombuffer(zlib.decompress(packed), dtype=width)
                at = 0
                while at < total:
                    part = ids[at : at + length - filled]
                    held.append((doc_id, at, part, total))
                    at, filled = at + len(part), filled + len(part)
                    if filled == length:
                        yield from closed(held, sequence, [length])
                        held, filled, sequence = [], 0, sequence + 1
            if filled:
                yield from closed(held, sequence, powers(filled))

        yield from in_batches(rows(), PIECES)

    return tokens.repartitionByRange(tasks, "curve", "doc_id").sortWithinPartitions("curve", "doc_id").select("doc_id", "n", "ids").mapInArrow(run, PIECES_DDL)
