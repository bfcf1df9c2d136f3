"""Ranked search against a plain score of every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tabscout.llm import search
from tabscout.llm.common import table

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute_search(docs, items, best):
    """docs: (doc_id, text), items: (item_id, text) -> sorted (item_id, rank, doc_id, score)."""
    counts = [(i, Counter(brute_terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    total, tokens = len(counts), sum(n for *_, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for doc_id, c, n in counts:
            m = 50 + (50 * n * total) // tokens
            score = sum(math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(brute_terms(text)) if t in c)
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scored, key=lambda x: x[:3])[:best])]
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def odd_documents(seed, n=300):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(30)] + ["Ärger", "été", "naïve", "x1y", "日本"]
    docs = [(k, rng.choice([" ", "-", ", "]).join(rng.choices(words, weights=[1 / (j + 1) for j in range(len(words))], k=rng.randint(1, 30)))) for k in range(n)]
    same = "w0 w1 W2 w3"
    docs += [(1000 - k, same) for k in range(120)] + [(7, same), (7, same), (None, same), (None, "w5 w5"), (None, None)]
    docs += [(2000, None), (2001, ""), (2002, " \n.,-"), (2003, "w1 " * 20_000 + "rare"), (2004, "\x00w1\x7fW1 ÀÉ w29")]
    rng.shuffle(docs)
    return docs


ITEMS = [(1, "w0 w1 w2"), (2, "w0 w0 RARE"), (3, "nothing here"), (4, None), (5, ""), (6, "Ärger, ärger w29 ÀÉ"), (None, "w3 w4"), (1, "w0 w1 w2"), (8, " ".join(f"w{k}" for k in range(30)))]


@pytest.mark.parametrize("best, postings, documents, depth", [(50, 1 << 20, 1 << 14, 256), (7, 40, 10, 1), (3, 500, 64, 2), (1, 1, 1, 1)])
def test_search_equals_plain_scores(spark, monkeypatch, best, postings, documents, depth):
    monkeypatch.setattr(search, "CHUNK_POSTINGS", postings)
    monkeypatch.setattr(search, "CHUNK_DOCUMENTS", documents)
    docs = odd_documents(best)
    df = spark.createDataFrame([(i, t, "x", -1) for i, t in docs], "doc_id long, text string, item string, score int").repartition(3)
    items = spark.createDataFrame([(i, t, 5) for i, t in ITEMS], "item_id long, text string, doc_id int")
    assert rows_of(search.search(df, items, best)) == brute_search(docs, ITEMS, best)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(search, "BLOCK_BYTES", 60)
    docs = odd_documents(5, 60)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sum(1 for _ in search.item_blocks(items)) > 2
    assert rows_of(search.search(df, items, 10)) == brute_search(docs, ITEMS, 10)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    full = spark.createDataFrame(ITEMS, "item_id long, text string")
    some = spark.createDataFrame([(1, "w0")], "doc_id long, text string")
    for a, b in ((docs, items), (docs, full), (some, items)):
        out = search.search(a, b)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


def test_reading_ends_early_and_resolves_ties():
    """A list whose documents are settled isn't read on; documents level with the last place stay until they are."""
    ids = search.pa.array(list(range(5000)))
    document = np.concatenate([np.arange(5000), np.arange(10)])
    term = np.concatenate([np.full(5000, 1), np.full(10, 2)])
    impact = np.concatenate([np.full(5000, 3), np.full(10, 100)])
    lists = search.Lists(ids, document, term, impact, 2)
    found, score = lists.search(np.array([1, 2]), 5, 0)
    assert set(found) == set(range(10)) and set(score) == {103}
    assert len(lists.search(np.array([1]), 5, 0)[0]) == 5000
    assert len(lists.search(np.array([1]), 5, 4)[0]) == 0


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    assert rows_of(search.search(docs, items)) == want
