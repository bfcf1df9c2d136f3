"""Merkle fingerprints of documents: leaves within paragraphs, paragraphs within sections, sections under a root.

Sections are what blank lines ("\\n\\n") part, paragraphs are lines, and a leaf is a run of LEAF characters counted from
the paragraph's start, so an edit changes leaves of its own paragraph only. Digests go up the tree; equal roots mean
equal texts, and where roots differ the differing branches lead to the edit (`edited_paragraphs`). A fingerprint is
root:sections:leaves in hexadecimal; likeness is one for equal roots, else the share of leaves that both have.

`edited_report` compares each document with itself after an edit that borrows from the next document. Neighbours meet
in one shuffle: a monotone bucket of doc_id deals documents out, and the first one of a bucket also goes to the end of
the bucket before.

Only DataFrame functions. Defined cases: a null or empty text is one empty paragraph without leaves, alike only to
itself; documents of one doc_id (null first) follow each other by the hashes of their texts, repeated rows are
documents of their own; a lone document is its own next; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tabscout.llm.common import documents_text, written

LEAF = 32
# Buckets hold about so many bytes; there are at most so many of them, a quantile's cell being cut into equal widths.
BUCKET_BYTES, MAX_BUCKETS, CELLS = 8 << 20, 65_536, 256
NULL_ID = -(1 << 63)


def leaf_digests(text: Column) -> Column:
    """Sections of paragraphs of digests of leaves."""
    leaves = lambda p: F.transform(F.regexp_extract_all(p, F.lit(f"(?s).{{1,{LEAF}}}"), F.lit(0)), lambda leaf: F.md5(leaf))
    return F.transform(F.split(text, "\n\n"), lambda s: F.transform(F.split(s, "\n"), leaves))


def with_tree(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Adds {prefix}paragraphs (digests by section), {prefix}sections, {prefix}root and {prefix}leaves (32-bit labels).
    Each step's column is used more than once by the next, so that the optimizer keeps the steps apart."""
    digests, paragraphs, sections = f"{prefix}digests", f"{prefix}paragraphs", f"{prefix}sections"
    df = df.withColumn(digests, leaf_digests(F.col(text)))
    df = df.withColumn(paragraphs, F.transform(digests, lambda s: F.transform(s, lambda p: F.md5(F.array_join(p, ",")))))
    df = df.withColumn(f"{prefix}leaves", F.transform(F.flatten(F.flatten(digests)), lambda d: F.hash(d))).drop(digests)
    df = df.withColumn(sections, F.transform(paragraphs, lambda s: F.md5(F.array_join(s, ","))))
    return df.withColumn(f"{prefix}root", F.md5(F.array_join(sections, ",")))


def fingerprint(prefix: str = "") -> Column:
    short = F.transform(f"{prefix}sections", lambda d: F.substring(d, 1, 8))
    labels = F.transform(f"{prefix}leaves", lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(0xFFFFFFFF))), 8, "0"))
    return F.concat(F.col(f"{prefix}root"), F.lit(":"), F.array_join(short, ""), F.lit(":"), F.array_join(labels, ""))


def likeness(left: str, right: str) -> Column:
    """One for equal roots; else twice the common distinct leaves over those of both, and below one."""
    a, b = F.col(f"{left}leaves"), F.col(f"{right}leaves")
    both = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b))
    share = 2 * F.size(F.array_intersect(a, b)) / F.greatest(both, F.lit(1))
    return F.when(F.col(f"{left}root") == F.col(f"{right}root"), F.lit(1.0)).otherwise(F.least(share, 1 - 1 / (both + 1)))


def edited_paragraphs(left: str, right: str) -> Column:
    """(section, paragraph), counted from zero, where two trees differ; sections with equal digests are not opened."""
    def paragraphs(pair: Column, s: Column) -> Column:
        each = F.zip_with(F.coalesce(pair["a"], F.array()), F.coalesce(pair["b"], F.array()), lambda x, y: ~x.eqNullSafe(y))
        return F.filter(F.transform(each, lambda changed, p: F.when(changed, F.struct(s.alias("section"), p.alias("paragraph")))), lambda x: x.isNotNull())

    sections = F.zip_with(F.col(f"{left}paragraphs"), F.col(f"{right}paragraphs"), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.flatten(F.transform(sections, lambda pair, s: F.when(pair["a"].eqNullSafe(pair["b"]), F.array().cast("array<struct<section:int,paragraph:int>>")).otherwise(paragraphs(pair, s))))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row."""
    return with_tree(docs.select("doc_id", documents_text(docs).alias("_text")), "_text").select("doc_id", fingerprint().alias("fingerprint"))


def _cell(value: Column, bounds: list[int], low: int, high: int) -> Column:
    """The number of bounds at most the value, by halving."""
    if low == high:
        return F.lit(low)
    middle = (low + high) // 2
    return F.when(value < bounds[middle], _cell(value, bounds, low, middle)).otherwise(_cell(value, bounds, middle + 1, high))


def bucket_of(docs: DataFrame) -> Column:
    """A bucket number that never falls as doc_id grows."""
    facts = docs.agg(F.sum(F.octet_length("text") + 100), F.min("doc_id"), F.max("doc_id"), F.percentile_approx("doc_id", [k / CELLS for k in range(1, CELLS)], 10_000)).first()
    size, least, most, quantiles = facts
    if most is None:
        return F.lit(0)
    buckets = min(MAX_BUCKETS, max(1, math.ceil((size or 0) / BUCKET_BYTES)))
    cells = min(CELLS, buckets)
    bounds = sorted({quantiles[k * CELLS // cells - 1] for k in range(1, cells)} - {least})
    parts = math.ceil(buckets / cells)
    value = F.coalesce("doc_id", F.lit(NULL_ID))
    cell = _cell(value, bounds, 0, len(bounds))
    if parts == 1:
        return cell
    starts, ends = F.array(*map(F.lit, [least, *bounds])), F.array(*map(F.lit, [*bounds, most + 1]))
    at, width = starts[cell], ends[cell] - starts[cell]
    inner = F.floor((value - at).cast("double") / width.cast("double") * parts)
    return (cell * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), inner))).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text (the text of the next document by ascending doc_id; after the last: the first)."""
    hashes = [F.xxhash64(F.lit(k), docs["doc_id"], docs["text"]).alias(f"_h{k}") for k in (1, 2)]
    rows = docs.select("doc_id", documents_text(docs).alias("text"), bucket_of(docs).alias("_bucket"), *hashes)
    place = F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.col("_h1").alias("h1"), F.col("_h2").alias("h2"))
    # A row for each bucket, so at most MAX_BUCKETS rows of a few numbers.
    heads = written(rows.groupBy("_bucket").agg(F.min(place).alias("head")))
    order = Window.orderBy("_bucket")
    target = F.coalesce(F.lag("_bucket").over(order), F.max("_bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    guests = heads.select(F.col("head.h1").alias("_g1"), F.col("head.h2").alias("_g2"), target.alias("_guest_of"), F.lag("_bucket").over(order).isNull().alias("_wraps"))
    rows = rows.join(F.broadcast(guests), (F.col("_h1") == F.col("_g1")) & (F.col("_h2") == F.col("_g2")), "left")
    copies = F.when(F.col("_guest_of").isNull(), F.array(F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("guest"), F.lit(False).alias("last")))).otherwise(
        F.array(F.struct(F.col("_bucket").alias("bucket"), F.lit(False).alias("guest"), F.lit(False).alias("last")), F.struct(F.col("_guest_of").alias("bucket"), F.lit(True).alias("guest"), F.col("_wraps").alias("last"))))
    rows = rows.select("doc_id", "text", "_h1", "_h2", F.explode(copies).alias("c")).select("doc_id", "text", "_h1", "_h2", "c.*")
    return rows.withColumn("next_text", F.lead("text").over(in_order())).select("doc_id", "text", "next_text", "bucket", "guest", "last", "_h1", "_h2")


def in_order():
    return Window.partitionBy("bucket").orderBy("last", F.coalesce("doc_id", F.lit(NULL_ID)), "guest", "_h1", "_h2")


def edited_report(docs: DataFrame) -> DataFrame:
    """Per document its fingerprint, that of the edited text, and the likenesses to the edited text and to the next."""
    rows = with_tree(with_next(docs), "text", "own_")
    ahead = [F.lead(f"own_{c}").over(in_order()).alias(f"next_{c}") for c in ("leaves", "root")]
    rows = rows.select("*", *ahead).filter(~F.col("guest"))
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - cut), F.substr(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.withColumn("edited", edited)
    rows = with_tree(rows, "edited", "edited_")
    return rows.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint("own_").alias("fingerprint"), fingerprint("edited_").alias("edited_fingerprint"),
        likeness("own_", "edited_").alias("near_edited"), likeness("own_", "next_").alias("near_next"),
    )
