"""Vector codes against plain integers and all entries."""

import hashlib
import math
import random

import numpy as np
import pytest

from tabscout.llm import codes


def brute_nearest(part, book):
    far = [sum((a - b) ** 2 for a, b in zip(part, e)) for e in book]
    return far.index(min(far)), min(far)


def brute_codes(rows, entries=256, rounds=4):
    """rows: (vec_id, embedding, label) -> sorted (vec_id, code, error, label_error, digest)."""
    kept = [(i, [math.floor(1024 * x) for x in v], p) for i, v, p in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = len(kept[0][1]) // 4
    cut = [[v[p * size : (p + 1) * size] for p in range(4)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0] or 0, kept[k][1]))[:entries]
    books = [[cut[k][p] for k in first] for p in range(4)]
    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for c in cut:
                groups.setdefault(brute_nearest(c[p], books[p])[0], []).append(c[p])
            books[p] = [[sum(x) // len(g) for x in zip(*g)] if (g := groups.get(e)) else old for e, old in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [[brute_nearest(c[p], books[p]) for p in range(4)] for c in cut]
    errors = [sum(d for _, d in f) for f in found]
    labels = {}
    for (_, _, p), e in zip(kept, errors):
        labels[p] = labels.get(p, 0) + e
    return sorted(((i, "".join(f"{e:02x}" for e, _ in f), err, labels[p], digest) for (i, _, p), f, err in zip(kept, found, errors)), key=str)


def coded_rows(spark, rows):
    df = spark.createDataFrame([(i, v, p, 1, "x") for i, v, p in rows], "vec_id long, embedding array<float>, label int, error int, vector string").repartition(3)
    return sorted((tuple(r) for r in codes.compressed(df).collect()), key=str)


def float_rows(seed, n, size=8, step=None):
    rng = random.Random(seed)
    rows = [(k, [float(np.float32(rng.gauss(0, 0.1))) if step is None else rng.randrange(-3, 4) * step for _ in range(size)], rng.choice([None, 0, 1])) for k in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("rows", [
    float_rows(1, 400), float_rows(2, 40), float_rows(3, 300, 4, 1 / 1024), float_rows(4, 1),
    float_rows(5, 200) + [(5, [0.5] * 8, None)] * 70 + [(None, [0.25] * 8, 1)] * 3 + [(7, [-0.5] * 8, 1), (7, [0.5] * 8, 1)],
    float_rows(6, 30) + [(90, None, 0), (91, [], 0), (92, [None] + [0.0] * 7, 0), (93, [float("nan")] * 8, 0), (94, [float("-inf")] * 8, 0)],
], ids=["random", "few", "ties", "one", "repeated", "unsound"])
def test_codes_equal_plain_integers(spark, rows):
    assert coded_rows(spark, rows) == brute_codes(rows)


def test_search_equals_all_entries():
    rng = np.random.default_rng(1)
    for size, spread in ((16, 200), (2, 3), (1, 2)):
        entries, x = rng.integers(-spread, spread, (200, size)), rng.integers(-2 * spread, 2 * spread, (3000, size))
        index, best = codes.Codebook(entries).nearest(x)
        far = ((x[:, None] - entries[None]) ** 2).sum(axis=2)
        assert (index == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_search_looks_at_few_entries_when_sums_tell():
    """Entries far off in their sums are never compared."""
    entries = np.arange(0, 256_000, 1000).repeat(4).reshape(-1, 4)
    book = codes.Codebook(entries)
    looked = []

    class Seen(np.ndarray):
        def __getitem__(self, key):
            looked.append(np.size(key))
            return np.asarray(super().__getitem__(key))

    book.entries = book.entries.view(Seen)
    book.nearest(entries + 3)
    assert sum(looked) <= 3 * len(entries)


def test_extremes_and_lengths(spark):
    huge = [(1, [3e38] * 8, 0), (2, [-3e38] * 8, 0), (3, [0.0] * 8, 0)]
    assert len(coded_rows(spark, huge)) == 3
    assert coded_rows(spark, []) == [] and coded_rows(spark, [(1, None, 0)]) == []
    for rows in ([(1, [0.0] * 8, 0), (2, [0.0] * 4, 0)], [(1, [0.0] * 6, 0)]):
        with pytest.raises(ValueError):
            coded_rows(spark, rows)
