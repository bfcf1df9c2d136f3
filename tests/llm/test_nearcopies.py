"""Near copies against the Jaccard similarity of all pairs."""

import random

import numpy as np
import pytest

import corpus_pipeline
from tabscout.llm import nearcopies, rules, simhash


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """The least document of each part, for rows of (doc_id, text) with distinct ids."""
    sets = [shingles(t) for _, t in rows]
    part = list(range(len(rows)))

    def root(k):
        while part[k] != k:
            k = part[k]
        return k

    for j in range(len(rows)):
        for k in range(j):
            both = len(sets[j] & sets[k])
            if sets[j] == sets[k] or (both and both / (len(sets[j]) + len(sets[k]) - both) >= 0.8):
                part[root(j)] = root(k)
    first = {}
    for k, (doc_id, _) in enumerate(rows):
        first[root(k)] = min(first.get(root(k), doc_id), doc_id)
    return sorted(first.values())


def planted(seed=4):
    """Unlike texts, and copies with some words changed so that similarities lie around and above 0.8."""
    rng = random.Random(seed)
    rows, doc_id = [], 0
    for k in range(60):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.choice((60, 200, 400)))]
        for copy in range(rng.choice((1, 2, 6))):
            changed = list(words)
            for _ in range(0 if copy == 0 else rng.randint(0, max(1, len(words) // 35))):
                changed[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            rows.append((doc_id, " ".join(changed)))
            doc_id += 1
    common = " ".join(f"shared{k}" for k in range(150))
    for k in range(80):
        rows.append((doc_id + k, common + " " + " ".join(f"own{k}x{j}" for j in range(120))))
    return rows + [(10_000, "a b"), (10_001, "A  b"), (10_002, ""), (10_003, None), (10_004, "a c")]


@pytest.mark.parametrize("block, columns", [(512, 4096), (3, 50)])
def test_near_copies_are_those_of_all_pairs(spark, monkeypatch, block, columns):
    monkeypatch.setattr(nearcopies, "BLOCK", block)
    monkeypatch.setattr(nearcopies, "COLUMNS", columns)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars")
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    assert sorted(r.doc_id for r in stage(spark, docs, "").collect()) == brute_kept(rows)


def test_documents_without_identity_stay(spark):
    prose = [" ".join(f"{c}{k}" for k in range(80)) for c in "abcd"]
    rows = [(None, prose[0]), (None, prose[1]), (7, prose[2]), (7, prose[3]), (7, prose[3]), (8, prose[3] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source", "1L as n_chars")
    stage = dict(corpus_pipeline.STAGES)["near duplicates"]
    assert sorted(r.text for r in stage(spark, docs, "").collect()) == prose
    assert stage(spark, docs.limit(0), "").count() == 0


def test_sketch_keeps_similar_sets():
    rng = np.random.default_rng(1)
    for n in (5, 40, 300):
        for _ in range(100):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            b = np.concatenate([a[: n - n // 9], rng.integers(0, 2**63, n // 9).astype(np.uint64)])
            (keys, sketch), (other, near) = nearcopies.signature(a), nearcopies.signature(b)
            assert (keys == other).any() and np.bitwise_count(sketch ^ near).sum() <= nearcopies.SKETCH


def test_group_around_one_text(spark):
    """Copies that are alike to their original and hardly to each other, with some that only another copy links."""
    rng = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    rows = [(0, " ".join(words))]
    for k in range(1, 150):
        changed = list(words)
        for at in rng.sample(range(300), 6 if k % 3 else 9):
            changed[at] = f"new{rng.randrange(10**6)}"
        rows.append((k, " ".join(changed)))
    far = rows[5][1].split()
    for at in range(0, 60, 12):
        far[at] = f"far{at}"
    rows.append((500, " ".join(far)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source")
    found = nearcopies.points(docs)
    links = nearcopies.similar_links(docs, nearcopies.written(found)).collect()
    assert len(links) < 30 * len(rows)
    assert sorted(r.doc_id for r in nearcopies.deduplicated(docs).collect()) == brute_kept(rows)


def test_band_recall_at_the_limit():
    """Of pairs at 0.8 the bands lose few."""
    rng = np.random.default_rng(5)
    met = []
    for _ in range(600):
        a = rng.integers(0, 2**63, 180).astype(np.uint64)
        b = np.concatenate([a[:160], rng.integers(0, 2**63, 20).astype(np.uint64)])
        met.append((nearcopies.signature(a)[0] == nearcopies.signature(b)[0]).any())
    assert np.mean(met) > 0.99


def test_shared_counts():
    rng = np.random.default_rng(6)
    left, right = ([rng.choice(200, size, replace=False) for size in sizes] for sizes in ((5, 0, 90), (30, 200)))
    assert nearcopies.shared_counts(left, right).tolist() == [[len(set(a) & set(b)) for b in right] for a in left]
    assert nearcopies.shared_counts([], right).shape == (0, 2)


def test_clashing_columns_and_long_texts(spark):
    long_text = " ".join(f"w{k % 5000}x{k // 7}" for k in range(60_000))
    rows = [(1, long_text, 1), (2, long_text + " end", 2), (3, "short one here now then", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row int").selectExpr("*", "'en' as lang", "'s' as source", "_row as _kept", "_row as key", "_row as _text")
    for stage in (nearcopies.deduplicated, simhash.deduplicated, rules.quality_filter):
        out = stage(docs)
        assert out.columns == docs.columns and all(r._row == r._kept == r.key == r.doc_id for r in out.collect())
    assert sorted(r.doc_id for r in nearcopies.deduplicated(docs).collect()) == [1, 3]
    assert nearcopies.deduplicated(docs.limit(0)).count() == 0
