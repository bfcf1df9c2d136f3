"""Fingerprints and groups against brute force over all pairs."""

import re

import numpy as np
import pytest
import xxhash

from tabscout.llm import graph, simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(points, distance):
    parent = list(range(len(points)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    array = np.array(points, dtype=np.uint64)
    for k in range(len(points)):
        for j in np.nonzero(np.bitwise_count(array ^ array[k]) <= distance)[0]:
            a, b = sorted((root(k), root(int(j))))
            parent[b] = a
    return [root(k) for k in range(len(points))]


def hamming_cloud(seed, n=1500):
    """Random points, chains and a dense cluster."""
    rng = np.random.default_rng(seed)
    points = [int(x) for x in rng.integers(0, 2**63, n)]
    center = points[0]
    for _ in range(400):
        points.append(center ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64))))
    walk = points[1]
    for _ in range(200):
        for b in rng.integers(0, 64, 4):
            walk ^= 1 << int(b)
        points.append(walk)
    return [p - (1 << 64) if p >= 1 << 63 else p for p in points]


@pytest.mark.parametrize("distance", [0, 1, 4, 6])
@pytest.mark.parametrize("block", [50, 20_000])
def test_close_fingerprints_find_every_component(spark, distance, block):
    points = sorted(set(hamming_cloud(distance)))
    df = spark.createDataFrame([(p,) for p in points], "fp long")
    links = simhash.close_fingerprints(df, distance, shard=40, block=block).collect()
    expected = brute_groups([p & (2**64 - 1) for p in points], distance)
    index = {p: k for k, p in enumerate(points)}
    labels = simhash.local_labels(np.array([index[r.a] for r in links], dtype=int), np.array([index[r.b] for r in links], dtype=int), np.arange(len(points)))
    assert labels.tolist() == expected
    assert len(links) < 30 * len(points)


def test_tree_keeps_close_points_together():
    rng = np.random.default_rng(1)
    points = rng.integers(0, 2**63, 4000).astype(np.uint64)
    for mask, radius in simhash.bands(4):
        tree = simhash.Tree(points, mask, radius, 50)
        bits = [b for b in range(64) if mask >> b & 1]
        near = points.copy()
        for _ in range(radius):
            near ^= np.uint64(1) << rng.choice(bits, len(points)).astype(np.uint64)
        homes = {}
        for name, index in tree.route(points):
            for k in index:
                homes.setdefault(int(k), set()).add(name)
        for name, index in tree.route(near):
            for k in index:
                homes.setdefault(int(k) + len(points), set()).add(name)
        assert tree.shards > 20
        assert all(homes[k] & homes[k + len(points)] for k in range(len(points)))


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    odd = [(-5, None), (-4, ""), (-3, " \n"), (-2, "One two"), (-1, "one TWO"), (5001, "É a b c d e"), (5001, "É a b c d e")]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(odd, "doc_id long, text string"))
    rows = docs.collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    parts = brute_groups(prints, 4)
    least = {}
    for r, p in zip(rows, parts):
        least[p] = min(least.get(p, r.doc_id), r.doc_id)
    expected = sorted((r.doc_id, f"{f:016x}", least[p]) for r, f, p in zip(rows, prints, parts))
    assert sorted(map(tuple, simhash.near_groups(docs).collect())) == expected
    full = docs.withColumn("lang", docs.text).withColumn("source", docs.text)
    kept = simhash.deduplicated(full)
    assert kept.columns == full.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(least.values()))


def test_no_documents(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, fp long")
    assert simhash.near_groups(docs).count() == 0
    assert simhash.deduplicated(docs).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 150)] + [(7, 7), (200, 201), (201, 200)]
    out = dict(graph.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert out == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 150)} | {200: 200, 201: 200}


def test_components_without_an_id_of_their_own_stay(spark):
    """Unlike texts with null ids, and two that share one id, are not each other's copies."""
    prose = [" ".join(f"{c}{k}" for k in range(80)) for c in "abcd"]
    rows = [(None, prose[0]), (None, prose[1]), (7, prose[2]), (7, prose[3]), (7, prose[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'en' as lang", "'s' as source")
    assert sorted(r.text for r in simhash.deduplicated(docs).collect()) == prose
