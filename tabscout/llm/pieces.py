"""SentencePiece encoding and decoding that keeps, for every piece, the bytes of the text it came from.

The normaliser walks the text by the longest prefix found in the model's compiled character map and records for each
normalised character where its source begins and ends; white space becomes the model's space symbol. Pieces are then
merged by score (byte pieces where a character has none), and each piece's span in the normalised text is projected to
the original bytes. Only models of kind BPE are read, those without user-defined or unused pieces.

Defined cases: a null text is an empty one and gives the end id alone; very long texts without a blank are merged with
a heap in n log n steps; repeated rows are encoded each; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabscout.llm.common import documents_text, in_batches, values

SPACE = "\u2581"
CACHE_WORDS = 400_000
LONG_SEGMENT = 40
DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("spans_crc32", pa.int64())])
DIGESTS_DDL = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"
ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("begins", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("decoded", pa.string())])
ENCODED_DDL = "doc_id long, ids array<int>, begins array<long>, ends array<long>, decoded string"


class CharMap:
    """The compiled map: a double-array trie over UTF-8 bytes whose leaves point to replacement texts."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], dtype="<u4").tolist() if blob else []
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest entry that the bytes from `at` begin with: its length and its replacement."""
        if not self.units:
            return None
        units, found = self.units, None
        node = self._jump(0)
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units) or (units[node] & 0x800000FF) != data[k]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                start = units[node] & 0x7FFFFFFF
                found = k + 1 - at, self.texts[start : self.texts.index(b"\0", start)]
        return found

    def _jump(self, node: int) -> int:
        unit = self.units[node]
        return node ^ ((unit >> 10) << ((unit & 0x200) >> 6))


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as formats

        model = formats.ModelProto()
        with open(path, "rb") as source:
            model.ParseFromString(source.read())
        kinds = formats.ModelProto.SentencePiece
        if model.trainer_spec.model_type != formats.TrainerSpec.BPE or any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("only BPE models without user-defined or unused pieces are supported")
        spec = model.normalizer_spec
        self.charmap = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        if model.trainer_spec.treat_whitespace_as_suffix or not self.escape:
            raise ValueError("only models with escaped white space before words are supported")
        self.names = [p.piece for p in model.pieces]
        normal = [(k, p) for k, p in enumerate(model.pieces) if p.type == kinds.NORMAL]
        self.cost = {p.piece: -p.score for _, p in normal}
        self.id = {p.piece: k for k, p in normal}
        self.bytes = {int(p.piece[3:5], 16): k for k, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else p.piece.encode() if p.type == kinds.NORMAL else None for p in model.pieces]
        self.is_byte = [p.type == kinds.BYTE for p in model.pieces]
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == kinds.UNKNOWN)
        self.unknown_text = model.trainer_spec.unk_surface
        self.end = model.trainer_spec.eos_id
        # Merges never cross a place where no piece has the two characters around it, so segments are cut there.
        crosses = any(SPACE in p.lstrip(SPACE) for p in self.cost)
        lines = not any("\n" in p and p != "\n" for p in self.cost)
        self.segments = re.compile("[\\s\\S]+" if crosses else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if lines else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.cache: dict[str, tuple] = {}

    # Normalisation

    def plain(self) -> bool:
        return not self.charmap.units and not self.squeeze

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its bytes, then its end, the byte of the source where it begins.
        Each byte of a replacement begins where the replaced prefix begins."""
        if not text:
            return "", np.zeros(1, dtype=np.int64)
        if self.plain():
            normal = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
            grown = np.frombuffer(normal.encode(), dtype=np.uint8)
            # A space of one byte stands as three: only the source's own bytes move the source position.
            return normal, self._plain_alignment(text, grown)
        data, out, source = text.encode(), bytearray(), []
        at, begin = 0, True
        space = SPACE.encode()

        def put(chunk: bytes, where: int) -> None:
            out.extend(chunk)
            source.extend([where] * len(chunk))

        chunks = []
        while at < len(data):
            found = self.charmap.longest(data, at)
            width = found[0] if found else utf8_width(data[at])
            chunks.append((at, found[1] if found else data[at : at + width]))
            at += width
        if self.squeeze:
            while chunks and not chunks[0][1].strip(b" "):
                chunks.pop(0)
        if not chunks:
            return "", np.array([len(data)], dtype=np.int64)
        if self.prefix:
            put(space, chunks[0][0])
        was_space = self.squeeze
        end = len(data)
        for where, chunk in chunks:
            for byte in (chunk[k : k + 1] for k in range(len(chunk))):
                if byte == b" ":
                    if not (self.squeeze and was_space):
                        put(space, where)
                    was_space = True
                else:
                    put(byte, where)
                    was_space = False
        if self.squeeze:
            while out.endswith(space) and len(out) >= 3:
                end = source[-3]
                del out[-3:], source[-3:]
        return out.decode(errors="replace"), np.array([*source, end], dtype=np.int64)

    def _plain_alignment(self, text: str, grown: np.ndarray) -> np.ndarray:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        widths = np.where(data == 32, 3, 1)
        source = np.repeat(np.arange(len(data)), widths)
        if self.prefix:
            source = np.concatenate([np.zeros(3, dtype=np.int64), source])
        return np.append(source, len(data))

    # Merging

    def merged(self, segment: str) -> list[str]:
        """The pieces of a segment: again and again the best-scored pair, leftmost first, is merged."""
        cost, parts, never = self.cost.get, list(segment), float("inf")
        if len(parts) > LONG_SEGMENT:
            return self._merged_long(parts)
        costs = [cost(x + y, never) for x, y in zip(parts, parts[1:])]
        while costs:
            best = min(costs)
            if best == never:
                break
            at = costs.index(best)
            parts[at] += parts.pop(at + 1)
            del costs[at]
            if at:
                costs[at - 1] = cost(parts[at - 1] + parts[at], never)
            if at < len(costs):
                costs[at] = cost(parts[at] + parts[at + 1], never)
        return parts

    def _merged_long(self, parts: list) -> list[str]:
        cost, n = self.cost, len(parts)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] >= 0:
                both = parts[k] + parts[after[k]]
                if both in cost:
                    heapq.heappush(heap, (cost[both], k, both))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, both = heapq.heappop(heap)
            nxt = after[k]
            if parts[k] is None or nxt < 0 or parts[k] + parts[nxt] != both:
                continue
            parts[k], parts[nxt] = both, None
            after[k] = after[nxt]
            if after[k] >= 0:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [p for p in parts if p is not None]

    def segment_entry(self, segment: str) -> tuple:
        """ids, their decimal text, their decoded bytes, and the normalised byte length of each piece. The bytes of a
        character without a piece share its span: the last byte piece has the length, those before it none."""
        parts = self.merged(segment)
        try:
            ids = [self.id[part] for part in parts]
            return ids, " ".join(map(str, ids)), "".join(parts).replace(SPACE, " "), bytes([len(part.encode()) for part in parts])
        except KeyError:  # a character without a piece
            ids, lengths = [], []
        for part in parts:
            raw = part.encode()
            if part in self.id:
                ids.append(self.id[part])
                lengths.append(len(raw))
            elif self.bytes:
                ids += [self.bytes[b] for b in raw]
                lengths += [0] * (len(raw) - 1) + [len(raw)]
            else:
                ids.append(self.unknown)
                lengths.append(len(raw))
        return ids, " ".join(map(str, ids)), self.decoded(ids), bytes(lengths)

    def decoded(self, ids: list[int]) -> str:
        """The text of some ids without the rule for the text's first piece."""
        out, waiting = [], bytearray()
        for k in ids:
            if self.is_byte[k]:
                waiting += self.raw[k]
                continue
            if waiting:
                out.append(repaired(bytes(waiting)))
                waiting.clear()
            if self.raw[k] is not None:
                out.append(self.raw[k].decode().replace(SPACE, " "))
            elif k == self.unknown:
                out.append(self.unknown_text)
        if waiting:
            out.append(repaired(bytes(waiting)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control ids say nothing, and one space before the first piece is the added prefix."""
        text = self.decoded(ids)
        return text[1:] if self.prefix and text.startswith(" ") else text

    def entries(self, text: str) -> tuple[list[tuple], np.ndarray]:
        normal, source = self.normalise(text)
        cache, out = self.cache, []
        for segment in self.segments.findall(normal):
            entry = cache.get(segment)
            if entry is None:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                entry = self.segment_entry(segment)
                if len(segment) <= LONG_SEGMENT:
                    cache[segment] = entry
            out.append(entry)
        return out, source

    def encode(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray, str]:
        """ids with the end id, the span of each id in the text's UTF-8 bytes (the end id's is empty), and the text
        decoded from the ids."""
        entries, source = self.entries(text)
        ids = [k for e in entries for k in e[0]] + [self.end]
        begins, ends = self.spans(entries, source)
        return ids, begins, ends, self.joined(entries)

    def spans(self, entries: list[tuple], source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lengths = np.frombuffer(b"".join([e[3] for e in entries]), dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        return np.append(source[begins], source[-1]), np.append(source[ends], source[-1])

    def joined(self, entries: list[tuple]) -> str:
        text = "".join([e[2] for e in entries])
        return text[1:] if self.prefix and text.startswith(" ") else text


def repaired(data: bytes) -> str:
    """Bytes of byte pieces as text; each byte that is no part of a character becomes U+FFFD."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(data):
            width = utf8_width(data[at])
            try:
                out.append(data[at : at + width].decode())
                at += width
            except UnicodeDecodeError:
                out.append("\ufffd")
                at += 1
        return "".join(out)


def utf8_width(first: int) -> int:
    return 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


@lru_cache(maxsize=2)
def model_of(path: str) -> PieceModel:
    return PieceModel(path)


def encode_documents(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids (with the end id), begins and ends (byte spans in the text), decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)

        def rows():
            for doc_id, text in values(batches, "doc_id", "text"):
                ids, begins, ends, decoded = model.encode(text)
                yield doc_id, ids, begins, ends, decoded

        yield from in_batches(rows(), ENCODED, 200)

    return docs.select("doc_id", documents_text(docs).alias("text")).mapInArrow(run, ENCODED_DDL)


def encode_digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Per document the number of ids, digests of ids and decoded text, and a check sum over all byte spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_path)

        def rows():
            for doc_id, text in values(batches, "doc_id", "text"):
                entries, source = model.entries(text)
                listed = " ".join([*[e[1] for e in entries], str(model.end)])
                begins, ends = model.spans(entries, source)
                yield (doc_id, len(begins), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(model.joined(entries).encode()).hexdigest(),
                       zlib.crc32(np.stack([begins, ends], axis=1).astype("<i8").tobytes()))

        yield from in_batches(rows(), DIGESTS)

    return docs.select("doc_id", documents_text(docs).alias("text")).mapInArrow(run, DIGESTS_DDL)
