"""Links of near-equal vectors against all pairs."""

import math

import numpy as np
import pytest

from tabscout.llm import polytope
from tabscout.llm.common import table


def sound(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)


def brute_links(rows, cosine):
    """rows: (vec_id, embedding, label) -> sorted (vec_id, n_links, component_id, kept)."""
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a, (_, u, p) in enumerate(rows):
        for b in range(a):
            _, v, q = rows[b]
            if p is None or p != q or not sound(u) or not sound(v) or len(u) != len(v):
                continue
            x, y = np.array(u, dtype=float), np.array(v, dtype=float)
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= cosine:
                links[a] += 1
                links[b] += 1
                parent[root(a)] = root(b)
    out = []
    for k, (vec_id, _, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(k) and rows[j][0] is not None]
        least = min(ids, default=None)
        out.append((vec_id, links[k], least, vec_id == least))
    return sorted(out, key=str)


def near_rows(spark, rows, cosine=0.93):
    df = spark.createDataFrame([(i, v, p, 3, "x") for i, v, p in rows], "vec_id long, embedding array<float>, label int, node int, links string").repartition(3)
    return sorted((tuple(r) for r in polytope.near_vectors(df, cosine).collect()), key=str)


def cloud(seed, size=16, n=150):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.standard_normal(size).astype("f4").tolist(), int(k % 3)) for k in range(n)]
    center = rng.standard_normal(size)
    rows += [(1000 - k, (center + rng.standard_normal(size) * 0.12).astype("f4").tolist(), 1) for k in range(120)]
    return rows


def test_odd_rows(spark):
    rows = cloud(1, 4)
    one = rows[0][1]
    rows += [(2000, one, 0), (2000, one, 0), (2001, one, 0), (2002, one, None), (2003, [x * 1e-30 for x in one], 0), (None, one, 0), (None, one, 1),
             (2004, None, 0), (2005, [], 0), (2006, [0.0] * 4, 0), (2007, [1.0, None, 0.0, 0.0], 0), (2008, [float("nan")] * 4, 0),
             (2009, [float("inf"), 0.0, 0.0, 0.0], 0), (2010, one[:3], 0), (2011, [-0.0, 0.0, 1.0, 0.0], 2), (2012, [0.0, -0.0, 1.0, 0.0], 2), (2013, [5.0], 2), (2014, [3.0], 2), (2015, [-3.0], 2)]
    assert near_rows(spark, rows) == brute_links(rows, 0.93)


@pytest.mark.parametrize("bucket, block, step", [(2048, 4096, 512), (4, 20, 7)])
def test_small_buckets_and_blocks_count_each_link_once(spark, monkeypatch, bucket, block, step):
    monkeypatch.setattr(polytope, "BUCKET", bucket)
    monkeypatch.setattr(polytope, "BLOCK", block)
    monkeypatch.setattr(polytope, "STEP", step)
    rows = cloud(2, 16)
    got, want = near_rows(spark, rows), brute_links(rows, 0.93)
    if bucket == 2048:
        assert got == want
    found, there = sum(r[1] for r in got), sum(r[1] for r in want)
    assert 0.98 * there <= found <= there
    assert all(g[1] <= w[1] for g, w in zip(got, want))


@pytest.mark.parametrize("size, vertices", [(64, 1), (64, 2), (100, 2), (5, 3), (1, 1), (2, 2)])
def test_random_pairs_meet(size, vertices):
    """Other random pairs than those the number of tables was taken from."""
    tables = polytope.needed_tables(size, vertices, 0.93)
    rng = np.random.default_rng(99)
    a = polytope.unit(rng.standard_normal((3000, size)))
    b = polytope.unit(a + 0.35 * polytope.unit(rng.standard_normal((3000, size))))
    close = (a * b).sum(axis=1) >= 0.93
    a, b = a[close], b[close]
    met = np.zeros(len(a), dtype=bool)
    for t in range(tables):
        met |= (polytope.probe_codes(a, t, vertices)[:, :, None] == polytope.probe_codes(b, t, vertices)[:, None, :]).any(axis=(1, 2))
    assert met.mean() >= 0.995


def test_rotation_keeps_lengths_and_the_nearest_vertex_comes_first():
    x = polytope.unit(np.random.default_rng(3).standard_normal((50, 32)))
    assert np.allclose(np.linalg.norm(polytope.hadamard(x), axis=1), 1)
    assert np.allclose(polytope.hadamard(polytope.hadamard(x)), x)
    codes = polytope.probe_codes(x, 0, 1)
    signs = np.random.default_rng((0, 0, 32)).choice([-1.0, 1.0], (polytope.ROUNDS, 32))
    for flips in signs:
        x = polytope.hadamard(x * flips)
    assert (codes[:, 0] // 2 == np.abs(x).argmax(axis=1)).all()
    assert all(len(set(c)) == polytope.PROBES for c in codes.tolist())


def test_empty_table(spark):
    assert near_rows(spark, []) == []


def test_recall_on_the_table(spark):
    df = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    x = polytope.unit(np.array([r[1] for r in rows], dtype=float))
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(x), dtype=bool)
    want = dict(zip([r[0] for r in rows], near.sum(axis=1).tolist()))
    got = {r.vec_id: r.n_links for r in polytope.near_vectors(df).collect()}
    assert all(got[i] <= want[i] for i in want) and sum(got.values()) >= 0.99 * sum(want.values())
