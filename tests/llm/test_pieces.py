"""Pieces, spans and decoded texts against the library, and the compiled map against a plain one."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tabscout.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts_are_encoded_as_by_the_library():
    rng = random.Random(11)
    parts = list("ab é▁ \n\t\0日本�") + ["<s>", "</s>", "<0x0A>", "the ", " of", "\U0001f600", "  ", "longerword" * 9]
    model = pieces.model_of(PATH)
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 2, 5, 20, 80])))
        ids, begins, ends, decoded = model.encode(text)
        want = LIBRARY.encode(text, add_eos=True)
        assert ids == want and decoded == model.decode(ids) == LIBRARY.decode(want), text
        spans = [(p.begin, p.end) for p in LIBRARY.encode(text, return_type="proto").pieces]
        assert list(zip(begins.tolist(), ends.tolist()))[:-1] == spans, text


def double_array(entries: dict[bytes, bytes]) -> bytes:
    """A compiled map of the given replacements."""
    texts, places = b"", {}
    for value in entries.values():
        places[value] = len(texts)
        texts += value + b"\0"
    units: dict[int, int] = {}

    def place(node: int, keys: list[tuple[bytes, bytes]]) -> None:
        labels = sorted({k[0] if k else 0 for k, _ in keys})
        offset = next(x for x in range(1, 1 << 20) if all((node ^ x ^ c) not in units and (node ^ x ^ c) != 0 for c in labels))
        leaf = any(not k for k, _ in keys)
        units[node] = units.get(node, 0) | offset << 10 | leaf << 8
        for c in labels:
            units[node ^ offset ^ c] = 0
        for c in labels:
            own = [(k[1:], v) for k, v in keys if k and k[0] == c]
            child = node ^ offset ^ c
            if c == 0 and leaf:
                units[child] = 1 << 31 | places[next(v for k, v in keys if not k)]
            if own:
                units[child] |= c
                place(child, own)

    place(0, list(entries.items()))
    array = b"".join(units.get(k, 0).to_bytes(4, "little") for k in range(max(units) + 256))
    return len(array).to_bytes(4, "little") + array + texts


def test_longest_prefix_of_a_compiled_map():
    entries = {"ﬁ": "fi", "Ａ": "A", "á": "á", "áb": "X", "​": "", "é": "e"}
    chars = pieces.CharMap(double_array({k.encode(): v.encode() for k, v in entries.items()}))
    rng = random.Random(5)
    for _ in range(500):
        data = "".join(rng.choice([*entries, "a", "b", "z", "́"]) for _ in range(8)).encode()
        for at in range(len(data)):
            want = max(((len(k.encode()), v.encode()) for k, v in entries.items() if data.startswith(k.encode(), at)), default=None)
            assert chars.longest(data, at) == want


def test_mapped_texts_keep_their_source():
    """With a map and squeezed white space, every normalised byte knows where it came from."""
    model = pieces.PieceModel(PATH)
    model.charmap = pieces.CharMap(double_array({"ﬁ".encode(): b"fi", "　".encode(): b" ", "​".encode(): b""}))
    model.squeeze = True
    normal, source = model.normalise("  ﬁne　 day​s ")
    assert normal == "▁fine▁days"
    data = "  ﬁne　 day​s ".encode()
    at = {c: data.index(c.encode()) for c in ("ﬁ", "n", "　", "d", "s")}
    starts = dict(zip([0, 3, 4, 5, 7, 10, 13], [2, at["ﬁ"], at["ﬁ"], at["n"], at["　"], at["d"], at["s"]]))
    assert {k: int(source[k]) for k in starts} == starts
    assert source[-1] == len(data) - 1


@pytest.mark.parametrize("digests", [True, False])
def test_documents(spark, sf_dir, digests):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(300)
    odd = [(-1, None), (-2, ""), (-3, "x" * 50_000), (-4, " lead"), (-4, " lead")]
    docs = docs.union(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 as ids").cache()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in docs.collect():
        ids = LIBRARY.encode(r.text or "", add_eos=True)
        want.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(LIBRARY.decode(ids))) if digests else (r.doc_id, ids, LIBRARY.decode(ids)))
    if digests:
        got = [tuple(r)[:4] for r in pieces.encode_digests(docs, PATH).collect()]
    else:
        got = [(r.doc_id, r.ids, r.decoded) for r in pieces.encode_documents(docs, PATH).collect()]
    assert sorted(got) == sorted(want)
    assert pieces.encode_digests(docs.limit(0), PATH).count() == 0
