"""Quality rules whose cut-offs follow the data: quantile sketches per language and source in place of fixed limits.

Every document gets a few shares (word length, symbols, capitals, repeated lines, repeated words). A mergeable KLL
sketch of each share is built per (language, source); sketches of a language and of all documents are merged from them
and serve small groups. A document is kept if the fixed base rule passes and no share lies far outside its group.

Only DataFrame functions. Defined cases: a null or empty text has no words and fails the base rule; null languages and
sources are groups of their own; repeated rows are judged each; an empty table gives no rows; other columns are kept by
`quality_filter` and ignored by `quality_report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabscout.llm.common import BLANKS, documents_text, free_name, join_by_key, written

SYMBOLS = "#*$%&|<>"
SHARES = ("word_length", "symbols", "capitals", "marks", "lines", "repeats")
# A fence lies REACH times as far from the median as the quantile HIGH does, and at least SLACK beyond that quantile.
MEDIAN, LOW, HIGH, REACH = 0.5, 0.2, 0.8, 4.0
SLACK = {"word_length": 1.5, "symbols": 0.1, "capitals": 0.15, "marks": 0.1, "lines": 0.35, "repeats": 0.3}
# Groups with fewer documents use the fences of their language, languages with fewer those of all documents.
LEAST = 200
SKETCH_K = 400


def without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the shares of each row."""
    text = documents_text(docs)
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    df = docs.select("doc_id", "lang", "source", row_key(docs).alias("_row"), text.alias("_text"))
    lines = F.filter(F.split("_text", "\n"), lambda line: without(line, BLANKS) != "")
    df = df.select(
        "doc_id", "lang", "source", "_row",
        F.array_remove(F.split(F.translate("_text", BLANKS, " " * len(BLANKS)), " "), "").alias("_words"),
        F.length(without(F.col("_text"), BLANKS)).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        (F.length("_text") - F.length(without(F.col("_text"), capitals))).alias("_capitals"),
        (F.length("_text") - F.length(without(F.col("_text"), "!?;:=+~^_{}[]/\\@"))).alias("_marks"),
        lines.alias("_lines"),
    )
    n = F.size("_words")
    # Columns below are used more than once each, so that the optimizer keeps these steps apart.
    df = df.select(
        "doc_id", "lang", "source", "_row", "word_chars", "n_symbols", "_capitals", "_marks", n.cast("long").alias("n_words"),
        F.size("_lines").alias("_n_lines"), (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(n >= 3, F.transform(F.arrays_zip(*(F.slice("_words", k, n - 2).alias(f"w{k}") for k in (1, 2, 3))), lambda w: F.xxhash64(w))).alias("_windows"),
    )
    repeats = F.size(F.array_distinct("_windows")) < F.size("_windows")
    df = df.withColumn("_sorted", F.when(repeats, F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    ahead, behind = F.slice("_sorted", 2, F.size("_sorted") - 1), F.slice("_sorted", 1, F.size("_sorted") - 1)
    twins = F.zip_with(behind, ahead, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")))
    df = df.withColumn("_starts", F.sort_array(F.array_distinct(F.flatten(twins))))
    steps = F.zip_with(F.slice("_starts", 1, F.size("_starts") - 1), F.slice("_starts", 2, F.size("_starts") - 1), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.when(F.size("_starts") > 0, F.lit(3) + F.aggregate(steps, F.lit(0), lambda total, step: total + step)).otherwise(0)
    df = df.withColumn("n_repeat_words", covered.cast("long"))
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return df.select(
        "doc_id", "lang", "source", "_row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (F.col("word_chars") / words).alias("word_length"), (F.col("n_symbols") / words).alias("symbols"),
        (F.col("_capitals") / chars).alias("capitals"), (F.col("_marks") / words).alias("marks"),
        (F.col("n_dup_lines") / F.greatest("_n_lines", F.lit(1))).alias("lines"), (F.col("n_repeat_words") / words).alias("repeats"),
    )


def row_key(docs: DataFrame) -> Column:
    """Two hashes of what a verdict depends on, to find the row again."""
    columns = [docs[c] for c in ("doc_id", "lang", "source", "text")]
    return F.struct(F.xxhash64(F.lit(1), *columns).alias("a"), F.xxhash64(F.lit(2), *columns).alias("b"))


def group_key(*names: str) -> Column:
    """One text for several nullable columns; different values give different texts."""
    return F.concat(*(F.concat(F.coalesce(F.length(n).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(F.col(n), F.lit(""))) for n in names))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fences(measured: DataFrame) -> DataFrame:
    """_group (language and source), _n (its documents), and the lowest and highest usual value of each share."""
    own = measured.groupBy("lang", "source").agg(
        F.count("*").alias("_n"), *(F.kll_sketch_agg_double(s, SKETCH_K).alias(s) for s in SHARES))
    own = written(own)  # a few kilobytes a group, read three times
    merged = [F.kll_merge_agg_double(s, SKETCH_K).alias(s) for s in SHARES]
    everything = own.agg(F.sum("_n").alias("_n"), *merged).filter("_n > 0")  # an empty sketch has no quantiles
    languages = own.groupBy("lang").agg(F.sum("_n").alias("_lang_n"), *merged)

    def bounds(prefix: str) -> list[Column]:
        out = []
        for s in SHARES:
            low, mid, high = (F.kll_sketch_get_quantile_double(s, F.lit(q)) for q in (LOW, MEDIAN, HIGH))
            out += [F.least(mid - REACH * (mid - low), low - SLACK[s]).alias(f"{prefix}{s}_low"),
                    F.greatest(mid + REACH * (high - mid), high + SLACK[s]).alias(f"{prefix}{s}_high")]
        return out

    # One row, and one row for each language; languages are grouped sums, joined by key and not broadcast by hint.
    world = everything.select(*bounds("world_"))
    by_lang = languages.select(F.col("lang").alias("_lang"), "_lang_n", *bounds("lang_"))
    table = own.select("lang", "source", "_n", *bounds("own_")).join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").join(F.broadcast(world))
    chosen = [F.when(F.col("_n") >= LEAST, F.col(f"own_{s}_{e}")).when(F.col("_lang_n") >= LEAST, F.col(f"lang_{s}_{e}")).otherwise(F.col(f"world_{s}_{e}")).alias(f"{s}_{e}") for s in SHARES for e in ("low", "high")]
    return table.select(group_key("lang", "source").alias("_group"), "_n", *chosen)


def judged(docs: DataFrame) -> DataFrame:
    """The measures with base_failed and kept. Measures are written once: they feed both sketches and verdicts."""
    measured = written(measures(docs))
    limits = written(fences(measured))
    rows = join_by_key(measured.withColumn("_group", group_key("lang", "source")), limits, "_group", "_n")
    usual = F.lit(True)
    for s in SHARES:
        usual = usual & F.col(s).between(F.col(f"{s}_low"), F.col(f"{s}_high"))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & usual)


def quality_report(docs: DataFrame) -> DataFrame:
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def rows_with_key(docs: DataFrame, kept: DataFrame, once: bool = True) -> DataFrame:
    """The rows of docs whose key is in kept (key), whatever their columns are called; of equal keys one row if ``once``."""
    own, other = free_name(docs, "_row"), free_name(docs, "_kept")
    rows = docs.withColumn(own, row_key(docs)).join(kept.select(F.col("key").alias(other)), F.col(own) == F.col(other), "left_semi")
    return (rows.dropDuplicates([own]) if once else rows).drop(own)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns."""
    return rows_with_key(docs, judged(docs).filter("kept").select(F.col("_row").alias("key")).distinct(), once=False)
