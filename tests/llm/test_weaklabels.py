"""Labellers' accuracies from votes alone, and scores against held-out labels."""

import numpy as np

from tabscout.llm import weaklabels


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(4)
    n, right, speaks = 40_000, np.array([0.9, 0.8, 0.7, 0.95, 0.6]), np.array([0.9, 0.7, 0.8, 0.4, 0.9])
    truth = rng.random(n) < 0.7
    votes = np.full((n, 5), weaklabels.SILENT)
    for k in range(5):
        said = np.where(rng.random(n) < right[k], truth, ~truth).astype(int)
        votes[:, k] = np.where(rng.random(n) < speaks[k], said, weaklabels.SILENT)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    good, said = weaklabels.fit_labellers(patterns, counts.astype(float))
    assert abs(good - 0.7) < 0.03
    for k in range(5):
        assert abs(said[k, 1, 1] / (said[k, 1, 0] + said[k, 1, 1]) - right[k]) < 0.04
        assert abs(said[k, 1, weaklabels.SILENT] - (1 - speaks[k])) < 0.03
    # As sure as one who knows the planted figures.
    known = np.empty((5, 2, 3))
    for k in range(5):
        known[k] = [[right[k] * speaks[k], (1 - right[k]) * speaks[k], 1 - speaks[k]], [(1 - right[k]) * speaks[k], right[k] * speaks[k], 1 - speaks[k]]]
    found, best = (((weaklabels.posterior(votes, *by) >= 0.5) == truth).mean() for by in ((good, said), (0.7, known)))
    assert found > best - 0.003


def test_sample_at_any_size():
    for texts in (1, 1000, 10**6, 10**10, 10**12, 10**15):
        limit = weaklabels.sample_limit(texts)
        assert 0 < limit <= weaklabels.KEYS
        assert abs(limit / weaklabels.KEYS * texts - min(texts, weaklabels.SAMPLE)) < 1


def test_many_copies_are_one_row_of_the_fit():
    """The number of a row is its weight, and equal numbers change nothing."""
    rng = np.random.default_rng(6)
    x, y = rng.random((64, 5)).astype(np.float32), np.full(64, 0.5, dtype=np.float32)
    y[0] = 1.0
    once = np.ones(64, dtype=np.float32)
    assert np.allclose(weaklabels.descend(x, y, once), weaklabels.descend(x, y, 3 * once), atol=1e-5)
    often = once.copy()
    often[0] = 1e6
    score = [float(x[0] @ w[:-1] + w[-1]) for w in (weaklabels.descend(x, y, n) for n in (once, often))]
    assert score[1] > score[0]


def test_given_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    out = [r for r in weaklabels.quality_scores(docs).collect() if r.doc_id in labels]
    good = [r for r in out if labels[r.doc_id]]
    bad = [r for r in out if not labels[r.doc_id]]
    assert np.mean([r.kept for r in good]) > 0.995
    assert np.mean([r.kept for r in bad]) < 0.4
    ranked = np.argsort(np.argsort([r.score for r in good + bad]))
    auc = (ranked[: len(good)].sum() - len(good) * (len(good) - 1) / 2) / len(good) / len(bad)
    assert auc > 0.85


def test_odd_rows(spark):
    rows = [(None, None), (1, ""), (2, "a"), (3, "x" * 3_000_000), (4, "the end of it. " * 30), (4, "the end of it. " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as pattern", "2 as key")
    out = weaklabels.quality_scores(docs).collect()
    assert sorted(str(r.doc_id) for r in out) == ["1", "2", "3", "4", "4", "None"]
    assert len({(r.score, r.posterior) for r in out if r.doc_id == 4}) == 1
    assert weaklabels.quality_scores(docs.limit(0)).count() == 0
