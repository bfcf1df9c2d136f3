"""Fingerprints of documents and their edits against a plain Python version."""

import hashlib

from pyspark.sql import functions as F

from tabscout.llm import merkle


def expected(rows):
    rows = [(d, t or "") for d, t in rows]
    out = {}
    for k, (d, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 4
        edited = t[: len(t) - cut] + following[:cut]
        out[d] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), edited == t, following == t)
    return out


def run(docs, monkeypatch=None):
    return {r.doc_id: r for r in merkle.edited_report(docs).collect()}


def check(found, want):
    assert set(found) == set(want)
    for d, (n, digest, same, same_next) in want.items():
        r = found[d]
        assert (r.n_chars, r.edited_sha256) == (n, digest), d
        assert (r.near_edited == 1.0) == (r.fingerprint == r.edited_fingerprint) == same
        assert (r.near_next == 1.0) == same_next
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1


def test_given_documents(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    want = expected(rows)
    check(run(docs), want)
    # Many more buckets than quantile cells.
    monkeypatch.setattr(merkle, "BUCKET_BYTES", 3000)
    found = run(docs)
    check(found, want)
    texts = dict(rows)
    long = [r for d, r in found.items() if len(texts[d]) >= 400]
    assert sum(r.near_edited for r in long) / len(long) > 0.6
    assert sum(r.near_next for r in long) / len(long) < 0.2
    by_text = {}
    for d, r in found.items():
        by_text.setdefault(texts[d], set()).add(r.fingerprint)
    assert all(len(prints) == 1 for prints in by_text.values())
    assert len({r.fingerprint for r in found.values()}) == len(by_text)


def test_odd_rows(spark):
    rows = [(None, "null id"), (1, None), (2, ""), (5, "é" * 7), (9, "a\n\nb\n\n\nc"), (10**12, "far away " * 50), (-(10**15), "first\nof all"), (10**18, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("clash")).withColumn("edited", F.lit(1))
    check(run(docs), expected([rows[0], *sorted(rows[1:])]))
    check(run(docs.filter("doc_id = 9")), expected([(9, "a\n\nb\n\n\nc")]))
    assert merkle.edited_report(docs.limit(0)).count() == 0
    twice = merkle.edited_report(spark.createDataFrame([(1, "same text here")] * 3 + [(1, "other text")], "doc_id long, text string")).collect()
    assert len(twice) == 4 and sum(r.near_next == 1.0 for r in twice) >= 2


def test_differing_branches_lead_to_the_edit(spark):
    left = "one\ntwo\n\nthree\nfour\nfive\n\nsix"
    pairs = [(left, left), (left, left.replace("four", "FOUR")), (left, left + "\nseven"), (left, left + "\n\nseven"), ("a\n\nb", "a\n\n\nb")]
    df = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    df = merkle.with_tree(merkle.with_tree(df, "a", "a_"), "b", "b_")
    out = {r.k: [tuple(x) for x in r.at] for r in df.select("k", merkle.edited_paragraphs("a_", "b_").alias("at")).collect()}
    assert out == {0: [], 1: [(1, 1)], 2: [(2, 1)], 3: [(3, 0)], 4: [(1, 0), (1, 1)]}


def test_no_python_in_the_plan(spark, sf_dir):
    plan = merkle.edited_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
