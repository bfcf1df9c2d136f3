"""Packing: every id once, no padding to speak of, and a curve that is a Hilbert curve."""

import itertools
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tabscout.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_curve_visits_every_cell_in_unit_steps():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        keys = packing.hilbert(points, bits)
        order = np.argsort(keys)
        assert keys[order].tolist() == list(range(len(points)))
        assert (np.abs(np.diff(points[order], axis=0)).sum(axis=1) == 1).all()


def test_words_are_the_tokenizers():
    own = Tokenizer.from_file(PATH)
    texts = ["", "Hello  World's\n\tend x", "<|startoftext|>a b<|endoftext|>", "é ΣΑΣ ﬁ 12 !?", " x\u0085y \x1cz " + "long" * 500]
    for text, ids in zip(texts, packing.words_of(PATH).ids(texts)):
        assert ids.tolist() == own.encode(text, add_special_tokens=False).ids


def test_pieces_cover_every_id_once(spark):
    own = Tokenizer.from_file(PATH)
    texts = [None, "", "one two three", "word " * 6000, *(f"text number {k} of a few " * (k % 40) for k in range(150)), "same text", "same text"]
    docs = spark.createDataFrame([(k, t, "z") for k, t in enumerate(texts)], "doc_id long, text string, offset string")
    pieces = packing.pack(docs, PATH, tasks=3).toPandas()
    for doc_id, own_pieces in pieces.groupby("doc_id"):
        ids = np.array([*own.encode(texts[doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        own_pieces = own_pieces.sort_values("start")
        assert (own_pieces.doc_tokens == len(ids)).all()
        assert own_pieces.start.tolist() == [0, *own_pieces.length.cumsum().tolist()[:-1]]
        assert own_pieces.length.sum() == len(ids)
        for p in own_pieces.itertuples():
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert set(pieces.doc_id) == set(range(len(texts)))
    for _, sequence in pieces.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert sequence.offset.tolist() == [0, *sequence.length.cumsum().tolist()[:-1]]
        total = sequence.length.sum()
        assert total <= 2048 and total & (total - 1) == 0
    assert packing.pack(docs.limit(0), PATH).count() == 0


def test_copies_lie_side_by_side(spark):
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(["red", "blue", "green", "old", "new", "tree", "house", "car"], 60)) for _ in range(200)]
    docs = spark.createDataFrame([(k, texts[k % 200]) for k in range(400)], "doc_id long, text string")
    pieces = packing.pack(docs, PATH, tasks=2).toPandas()
    first = pieces[pieces.start == 0].sort_values(["sequence_id", "offset"]).doc_id.tolist()
    place = {d: k for k, d in enumerate(first)}
    assert sum(abs(place[k] - place[k + 200]) == 1 for k in range(200)) > 190
