"""Removed bytes against a dictionary of all strings."""

import hashlib
import random
from collections import Counter

import pytest

from tabscout.llm import suffixes


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for (d, _), t in zip(rows, texts):
        hit = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                hit[k : k + length] = b"\1" * length
        kept = bytes(b for b, h in zip(t, hit) if not h)
        spans = sum(h and (k == 0 or not hit[k - 1]) for k, h in enumerate(hit))
        out.append((str(d), len(t), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(docs, length, **how):
    return sorted((str(r.doc_id), *r[1:]) for r in suffixes.removal_report(docs, length, **how).collect())


def planted(seed, length):
    """Texts of a small alphabet and random words that share passages of lengths around the limit."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(12)] + ["ab" * 150, "z" * 400]
    rows = []
    for d in range(120):
        parts = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(passages)
            a, b = sorted((rng.randint(0, len(p)), rng.randint(0, len(p))))
            parts += [p[a:b] if rng.random() < 0.5 else p, " ".join(word() for _ in range(rng.randint(0, 20)))]
        rows.append((d, "".join(parts)))
    return rows + [(200, None), (201, ""), (202, rows[3][1]), (202, rows[3][1]), (None, "x" * (length - 1)), (None, rows[5][1][:-1] + "!")]


@pytest.mark.parametrize("seed,length,large", [(1, 200, 100_000), (2, 200, 1), (3, 40, 100_000), (4, 64, 2)])
def test_planted_passages(spark, monkeypatch, seed, length, large):
    rows = planted(seed, length)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffixes, "BATCH", 10)
    assert found(docs, length, large=large) == brute(rows, length)


def test_long_texts_are_cut_without_loss(monkeypatch):
    """A text in overlapping parts has each of its strings once."""
    import numpy as np

    monkeypatch.setattr(suffixes, "PIECE", 100)
    rng = random.Random(8)
    text = bytes(rng.choice(b"abc") for _ in range(1234))
    starts = []
    for keys, offsets, data, bounds in suffixes.pieces(iter([((1, 2), text), ((3, 4), text[:250])]), 50):
        t, anchor, first, last, _ = suffixes.runs_of(np.frombuffer(data, dtype=np.uint8), bounds, 50)
        for k, f, e in zip(t, first, last):
            shift = offsets[k] - bounds[k]
            starts += [(keys[k], int(s + shift)) for s in range(f, e + 1)]
    assert sorted(starts) == [((1, 2), s) for s in range(1185)] + [((3, 4), s) for s in range(201)]


def test_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert found(docs, 200) == brute(rows, 200)


def test_texts_without_their_repeats(spark):
    passage = "é shared passage " * 20
    rows = [(1, "en", passage + "one", "s", 9), (2, "en", passage + "two", "s", 9), (3, None, None, "s", None), (4, "en", "alone", "s", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string, ranges string, n_chars long")
    out = suffixes.deduplicated(docs)
    assert out.schema == docs.schema
    assert sorted(tuple(r) for r in out.collect()) == [(1, "en", "one", "s", 3), (2, "en", "two", "s", 3), (3, None, None, "s", None), (4, "en", "alone", "s", 5)]
    assert suffixes.deduplicated(docs.limit(0)).count() == 0 and suffixes.removal_report(docs.limit(0)).count() == 0
