"""Each stage of the pipeline against a brute-force version of it, on what the stage before kept."""

import corpus_pipeline
from tabscout.llm import pii, rules
from tabscout.llm.common import table, written
from tests.llm.test_nearcopies import brute_kept
from tests.llm.test_packing import PATH
from tokenizers import Tokenizer


def as_rows(df):
    return sorted(df.collect(), key=lambda r: (str(r.doc_id), r.text or ""))


def without_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for t in data:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for raw, t in zip(texts, data):
        hit = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                hit[k : k + length] = b"\1" * length
        out.append(None if raw is None else bytes(b for b, h in zip(t, hit) if not h).decode(errors="ignore"))
    return out


def test_stages(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near duplicates", "repeated passages", "personal data", "packing"]

    kept = written(stages["quality rules"](spark, docs, ""))
    verdicts = {r.doc_id for r in rules.quality_report(docs).collect() if r.kept}
    assert kept.columns == columns and as_rows(kept) == as_rows(docs.filter(docs.doc_id.isin(list(verdicts))))
    assert 0 < kept.count() < docs.count()

    rows = as_rows(kept)
    first = set(brute_kept([(r.doc_id, r.text) for r in rows]))
    single = written(stages["near duplicates"](spark, kept, ""))
    assert single.columns == columns and as_rows(single) == [r for r in rows if r.doc_id in first]
    assert single.count() < kept.count()

    rows = as_rows(single)
    texts = without_repeats([r.text for r in rows])
    cut = written(stages["repeated passages"](spark, single, ""))
    assert cut.columns == columns
    assert [(r.doc_id, r.text, r.n_chars, r.lang, r.source) for r in as_rows(cut)] == sorted(((r.doc_id, t, len(t), r.lang, r.source) for r, t in zip(rows, texts)), key=lambda x: (str(x[0]), x[1]))

    clean = written(stages["personal data"](spark, cut, ""))
    assert clean.columns == columns
    assert [r.text for r in as_rows(clean)] == [pii.mask_text(r.text) for r in as_rows(cut)]
    assert all(not pii.all_spans(r.text)[1] for r in as_rows(clean))

    pieces = stages["packing"](spark, clean, "").toPandas()
    own = Tokenizer.from_file(PATH)
    assert pieces.groupby("doc_id").length.sum().to_dict() == {r.doc_id: len(own.encode(r.text, add_special_tokens=False).ids) + 1 for r in clean.collect()}

    whole = corpus_pipeline.run(spark, "/root/testdata/sf0.001").toPandas()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert whole.groupby("doc_id").length.sum().to_dict() == pieces.groupby("doc_id").length.sum().to_dict()
    assert set(names) <= set(whole.columns)


def test_odd_rows(spark):
    """Nulls in every column, empty texts, repeated rows and no rows."""
    prose = " ".join(f"word{k % 97} other{k % 89}" for k in range(300))
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, prose, None, None, None), (2, prose, None, None, None), (3, prose + " end", "en", "a", 5), (4, "short", "en", None, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for start in (docs, docs.limit(0)):
        current = start
        for name, stage in corpus_pipeline.STAGES:
            out = written(stage(spark, current, ""))
            if name != "packing":
                assert out.columns == docs.columns
                assert out.count() <= current.count()
            current = out
