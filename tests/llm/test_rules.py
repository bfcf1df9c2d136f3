"""Base figures against plain Python, fences against exact quantiles, and the classes of odd rows."""

import re
from collections import Counter

import numpy as np

from tabscout.llm import rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    windows = list(zip(words, words[1:], words[2:]))
    seen = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_base_figures(spark, sf_dir):
    odd = [(-1, None, None, None), (-2, "", None, "x"), (-3, " \t\x0b\x0c\r\n", "en", None), (-4, "a b c a b c a b c", "en", "x"), (-5, "é ü   x\u0085y", "", ""), (-6, "same\nsame\n \n \nsame", "en", "x"), (-7, "w " * 30_000, "en", "x"), (-7, "w " * 30_000, "en", "x")]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").union(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"))
    docs = docs.withColumn("n_words", docs.text)
    texts = sorted((r.doc_id, brute(r.text)) for r in docs.collect())
    out = rules.quality_report(docs).collect()
    assert sorted((r.doc_id, (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed)) for r in out) == texts
    assert not any(r.kept and r.base_failed for r in out)
    kept = rules.quality_filter(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in out if r.kept)
    assert rules.quality_report(docs.limit(0)).count() == 0 and rules.quality_filter(docs.limit(0)).count() == 0


def test_given_labels(spark, sf_dir):
    """Documents of good quality stay, most of the others go."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    out = [r for r in rules.quality_report(docs).collect() if r.doc_id in labels]
    good = [r.kept for r in out if labels[r.doc_id] and not r.base_failed]
    bad = [r.kept for r in out if not labels[r.doc_id]]
    assert np.mean(good) > 0.995 and np.mean(bad) < 0.1


def test_fences_follow_the_group(spark):
    """The same text is usual in a source of such texts and far out in another."""
    plain = lambda k: " ".join(f"word{(k * 7 + j) % 300}" for j in range(60 + k % 9))
    marked = lambda k: " ".join(f"w{(k * 7 + j) % 300}##" for j in range(60 + k % 9))
    rows = [(k, plain(k), "en", "prose") for k in range(300)] + [(1000 + k, marked(k), "en", "code") for k in range(300)] + [(5000, marked(3), "en", "prose"), (6000, plain(5), "xx", "new")]
    kept = {r.doc_id for r in rules.quality_report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect() if r.kept}
    assert kept == {*range(300), *range(1000, 1300), 6000}


def test_sketched_fences_are_near_exact_ones(spark):
    rng = np.random.default_rng(0)
    values = {s: rng.gamma(2.0, 1.0, 20_000) for s in rules.SHARES}
    df = spark.createDataFrame([("en", "s", *map(float, row)) for row in zip(*values.values())], "lang string, source string, " + ", ".join(f"{s} double" for s in rules.SHARES))
    row = rules.fences(df.repartition(7)).first()
    for s in rules.SHARES:
        low, mid, high = np.quantile(values[s], [rules.LOW, rules.MEDIAN, rules.HIGH])
        assert abs(row[f"{s}_high"] - max(mid + rules.REACH * (high - mid), high + rules.SLACK[s])) < 0.3
        assert abs(row[f"{s}_low"] - min(mid - rules.REACH * (mid - low), low - rules.SLACK[s])) < 0.3


def test_no_python_in_the_plan(spark, sf_dir):
    plan = rules.measures(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_repeats_far_above_a_clean_source_are_stopped(spark):
    """Two fifths of repeated words pass the base rule, but not the fence of a source without repeats; nor do copied lines."""
    clean = [(k, " ".join(f"word{k}x{j}" for j in range(100)), "en", "s") for k in range(300)]
    own = [f"own{j}" for j in range(60)]
    repeated = (1000, " ".join(own + [f"again{j}" for j in range(20)] * 2), "en", "s")
    lines = (1001, "\n".join([" ".join(f"line{i}x{j}" for j in range(20)) for i in range(6)] + ["a b"] * 6), "en", "s")
    docs = spark.createDataFrame([*clean, repeated, lines], "doc_id long, text string, lang string, source string")
    out = {r.doc_id: (r.base_failed, r.kept) for r in rules.quality_report(docs).collect()}
    assert brute(repeated[1])[4] == 40 and out[1000] == (False, False) and out[1001] == (False, False)
    assert all(out[k] == (False, True) for k in range(300))
