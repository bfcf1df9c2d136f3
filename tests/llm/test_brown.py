"""Base scores against plain counting, the model as a distribution, clustering as a climb."""

import math
import re
import zlib
from collections import Counter

import numpy as np

from tabscout.llm import brown


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or "")) + [None]


def check_base(rows, found):
    held = {k for k, (d, _) in enumerate(rows) if d is not None and zlib.crc32(str(d).encode()) % 7 == 2}
    counts = Counter(t for k, (_, text) in enumerate(rows) if k not in held for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(d), k in held, len(tokens(t)), sum(counts[x] > 0 for x in tokens(t)), n,
                   round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in tokens(t)), 5)) for k, (d, t) in enumerate(rows))
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in found)
    assert got == want


def test_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    found = brown.score_documents(docs).collect()
    check_base(rows, found)
    held = [r for r in found if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)


def test_odd_rows(spark):
    rows = [(None, "null id"), (1, None), (2, ""), (3, "A b É"), (3, "A b É"), (4, "x " * 5000), (5, "w" * 1000 + " a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", docs_column())
    check_base(rows, brown.score_documents(docs).collect())
    assert brown.score_documents(docs.limit(0)).count() == 0
    only_held = [(d, "some text") for d in range(40) if zlib.crc32(str(d).encode()) % 7 == 2]
    out = brown.score_documents(spark.createDataFrame(only_held, "doc_id long, text string")).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in out)


def docs_column():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_model_is_a_distribution(spark, sf_dir):
    """After any class, the words of all classes, unknown ones as one event, have a total probability of one."""
    rows = brown.prepared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    model, counts = brown.trained(rows)
    assert np.allclose((10.0 ** model.transitions).sum(axis=1), 1)
    emitted = np.bincount(model.classes, weights=10.0 ** model.emission, minlength=brown.ALL_CLASSES)
    rare = [r.c for r in counts.collect() if bytes(r.word) not in model.index]
    emitted[brown.RARE_CLASS] = sum((c - model.discount) / model.rare_tokens for c in rare) + 10**model.unknown
    used = emitted > 0
    assert np.allclose(emitted[used], 1)
    assert used[: brown.CLASSES].all()
    # Every frequent word is in a cluster, and each round of exchanges raises the likelihood.
    assert (model.classes < brown.CLASSES).all()
    assert len(model.climb) > 1 and all(a < b for a, b in zip(model.climb, model.climb[1:]))
    usual = [bytes(r.word) for r in counts.collect() if r.c >= brown.LEAST_COUNT and len(r.word) <= brown.LONGEST_WORD]
    assert set(usual) == set(model.index)


def test_exchange_climbs_and_finds_planted_classes():
    rng = np.random.default_rng(2)
    groups, words = 4, 40
    of = np.arange(words) // 10
    after = np.roll(np.eye(groups), 1, axis=1) * 0.85 + 0.05
    pairs = rng.poisson(40 * after[of[:, None], of[None, :]]).astype(np.int64)
    start = np.arange(words) % groups
    found = brown.exchange(pairs, words, groups, np.zeros(0, dtype=int), 20)
    assert brown.likelihood(pairs, found, groups) > brown.likelihood(pairs, start, groups)
    assert all(len(set(found[of == g])) == 1 for g in range(groups))
    assert len(set(found)) == groups
    # No single move is better.
    best = brown.likelihood(pairs, found, groups)
    for w in range(words):
        for c in range(groups):
            other = found.copy()
            other[w] = c
            assert brown.likelihood(pairs, other, groups) <= best + 1e-6


def streams(spark, texts, words):
    """Coded texts of places, spread over a few tasks."""
    rows = [(np.array([*t, words + 1], dtype="<i4").tobytes(),) for t in texts]
    return spark.createDataFrame(rows, "codes binary").repartition(3)


def counted(texts, of, words):
    table = np.zeros((brown.ALL_CLASSES, brown.ALL_CLASSES))
    for t in texts:
        path = of[np.array([words + 1, *t, words + 1])]
        np.add.at(table, (path[:-1], path[1:]), 1)
    return table


def test_moves_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    words = 300  # three blocks, the last one not full
    texts = [rng.integers(0, words + 1, rng.integers(0, 30)).tolist() for _ in range(120)] + [[3, 3, 3, 3], [], [words]]
    of = np.append(rng.integers(0, brown.CLASSES, words), [brown.RARE_CLASS, brown.END_CLASS])
    table = counted(texts, of, words)
    codes = streams(spark, texts, words)
    assert (brown.summed_pairs(codes, [of], brown.ALL_CLASSES)[0] == table).all()
    best, gain = brown.best_moves(codes, of, table)
    now = brown.table_likelihood(table)
    for w in (0, 3, 127, 128, 299):
        reached = []
        for c in range(brown.CLASSES):
            other = of.copy()
            other[w] = c
            reached.append(brown.table_likelihood(counted(texts, other, words)) - now)
        assert abs(max(reached) - gain[w]) < 1e-6
        assert abs(reached[best[w]] - max(reached)) < 1e-6


def test_block_gains_equal_single_ones():
    """Many words at once against each word taken out of the table: own classes tried and not, words after themselves."""
    rng = np.random.default_rng(8)
    words, classes, total = 60, 5, 7
    of = rng.integers(0, total, words)
    pairs = rng.poisson(0.3, (words, words)).astype(float)
    pairs[7] = pairs[:, 7] = 0
    table = np.zeros((total, total))
    np.add.at(table, (of[:, None], of[None, :]), pairs)
    loop, rank = pairs.diagonal().copy(), np.arange(words)
    out = np.stack([pairs[:, of == k].sum(axis=1) for k in range(total)], axis=1)
    into = np.stack([pairs[of == k].sum(axis=0) for k in range(total)], axis=1)
    out[rank, of] -= loop
    into[rank, of] -= loop
    found = brown.block_gains(table, out, into, loop, of, classes)
    for w in range(words):
        rest = table.copy()
        rest[of[w]] -= out[w]
        rest[:, of[w]] -= into[w]
        rest[of[w], of[w]] -= loop[w]
        assert np.allclose(found[w], brown.move_gains(rest, out[w], into[w], loop[w], classes))


def test_rounds_find_planted_classes(spark):
    """Words beyond the seeds join the class of the seeds that stand in the same places."""
    rng = np.random.default_rng(3)
    words, groups = 120, 4
    texts = [[int(g % groups + groups * rng.integers(0, words // groups)) for g in range(k, k + 60)] for k in range(200)]
    of, table, climb = brown.clustered(streams(spark, texts, words), words, seeds=40, rounds=6)
    assert (counted(texts, of, words) == table).all()
    assert all(a < b for a, b in zip(climb, climb[1:]))
    assert brown.table_likelihood(table) == climb[-1]
    held = [set(of[g:words:groups]) for g in range(groups)]
    assert all(not held[a] & held[b] for a in range(groups) for b in range(a))
