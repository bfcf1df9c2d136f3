"""Personal data in texts: plain identifiers, and disguised ones found through an offset-preserving transducer.

Plain identifiers (`base_spans`) are read off the text as it is. For disguised ones the text is rewritten: characters
that look like ASCII ones, runs of spelled digits, "plus", and the words or brackets for "at" and "dot" become what
they stand for, and each rewritten character keeps the span of its source. Identifiers of the rewritten text are mapped
back, and those that are not part of a plain identifier of their kind are added; a plain one may be a rest of them.

All positions are code points, ends exclusive. Every search is linear in the text. Defined cases: a null text is an
empty one; repeated rows are searched each; other columns are kept by `masked` and ignored by `spans_of_documents`.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from tabscout.llm.common import documents_text, in_batches, values

# The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
# Letters of other scripts by the ASCII letters they look like.
LOOKALIKES = {
    "a": "аα", "b": "Ьв", "c": "сϲ", "d": "ԁ", "e": "еε", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "k": "кκ", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ",
    "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "т", "u": "υս", "v": "ѵν", "w": "ԝ", "x": "хχ", "y": "уγ", "z": "ᴢ",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "J": "Ј", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ",
    "X": "ХΧ", "Y": "ΥҮ", "Z": "Ζ", "@": "﹫", ".": "․﹒。｡", "-": "‐‑‒–—−", " ": "   ",
}
INVISIBLE = "​‌‍⁠﻿­"
DIGIT_WORDS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
ENDINGS = "com|org|net|edu|gov|info|io|co|uk|de|fr|es|eu|us|me|biz|ai|dev|app"

LOOKS = {ord(c): k for k, group in LOOKALIKES.items() for c in group} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {ord(c): "" for c in INVISIBLE}

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)", re.ASCII)
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

_word = "(?:" + "|".join(DIGIT_WORDS) + ")"
SPELLED = re.compile(rf"(?<![a-z0-9])(?:plus[ -]+)?(?:{_word}|[0-9]+)(?:[ ,-]+(?:{_word}|[0-9]+))*+(?![a-z0-9])(?:(?: dot |[ ]?[\[({{]dot[\])}}][ ]?|\.)(?:{_word}|[0-9]+)(?:[ ,-]+(?:{_word}|[0-9]+))*+(?![a-z0-9]))*")
SPELLED_HINT = re.compile(rf"(?<![a-z]){_word}[ ,-]+{_word}(?![a-z])")
SPELLED_PART = re.compile(rf"plus[ -]+|{_word}|[0-9]| dot |[ ]?[\[({{]dot[\])}}][ ]?|\.")
_open, _close = r"[ \t]*[\[({<][ \t]*", r"[ \t]*[\])}>][ \t]*"
AT = re.compile(rf"{_open}(?:at|@){_close}|[ \t]+at[ \t]+|@")
DOT = re.compile(rf"{_open}(?:dot|\.){_close}|[ \t]+dot[ \t]+|\.")
LABEL = re.compile(r"[a-z0-9-]+")
LETTERS = re.compile(r"[a-z]{2,}")
_group = rf"(?:[0-9]++|{_word}(?:[ ,-]+{_word}){{0,2}})(?![a-z0-9])"
_dot = rf"(?:{_open}(?:dot|\.){_close}|[ \t]+dot[ \t]+|\.)"
DOTTED = re.compile(rf"(?<![a-z0-9]){_group}(?:{_dot}{_group}){{3}}")
DOTTED_PART = re.compile(rf"{_word}|[0-9]++|{_dot}")
ENDING = re.compile(rf"(?:{ENDINGS})(?![a-z0-9-])")
LOCAL_TAIL = re.compile(r"[a-z0-9._%+-]+\Z")
DOT_TAIL = re.compile(rf"(?:{_open}(?:dot|\.){_close}|[ \t]+dot[ \t]+)\Z")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: before each at sign the whole run of local characters since the last match."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in LOCAL:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            after = found.end()
        # A run before the next at sign can't reach over this one.
        after, at = max(after, at + 1), text.find("@", max(after, at + 1))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every plain identifier, by kind, then start."""
    found = [("email", *span) for span in emails(text)]
    if "." in text:
        found += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


class Rewritten:
    """A text under rewriting: changes as (source start, source end, replacement) in order, without overlap."""

    def __init__(self, text: str, changes: list[tuple[int, int, str]]):
        parts, at, length = [], 0, 0
        self.starts, self.sources = [], []  # of each stretch of the new text, and its (source start, end, is copied)
        for start, end, new in changes:
            for piece, a, b, copied in ((text[at:start], at, start, True), (new, start, end, False)):
                if piece:
                    self.starts.append(length)
                    self.sources.append((a, b, copied))
                    parts.append(piece)
                    length += len(piece)
            at = end
        self.starts.append(length)
        self.sources.append((at, len(text), True))
        parts.append(text[at:])
        self.text = "".join(parts)

    def source(self, at: int) -> tuple[int, int]:
        """The span of the source of one character."""
        k = bisect_right(self.starts, at) - 1
        a, b, copied = self.sources[k]
        return (a + at - self.starts[k], a + at - self.starts[k] + 1) if copied else (a, b)

    def span(self, start: int, end: int) -> tuple[int, int]:
        return self.source(start)[0], self.source(end - 1)[1]


def look_changes(text: str) -> list[tuple[int, int, str]]:
    if text.isascii():
        return []
    out = []
    for k, c in enumerate(text):
        if c > "\x7f":
            new = LOOKS.get(ord(c))
            if new is None and c.isdigit():
                new = str(unicodedata.digit(c, ""))
            if new is not None:
                out.append((k, k + 1, new))
    return out


def spelled_changes(low: str) -> list[tuple[int, int, str]]:
    """Digits for runs of at least three digit words; separators between them vanish."""
    if not SPELLED_HINT.search(low):
        return []
    out = []
    for run in SPELLED.finditer(low):
        if len(re.findall(_word, run.group())) < 3:
            continue
        at = run.start()
        for part in SPELLED_PART.finditer(low, run.start(), run.end()):
            word = part.group()
            if part.start() > at:
                out.append((at, part.start(), ""))
            new = "+" if word.startswith("plus") else str(DIGIT_WORDS.index(word)) if word in DIGIT_WORDS else word if word.isdigit() else "."
            out.append((part.start(), part.end(), new))
            at = part.end()
    return out


def dotted_changes(low: str) -> list[tuple[int, int, str]]:
    """Figures and dots for four groups of figures or digit words between dots, if a dot or a group is disguised."""
    if "dot" not in low and not re.search(rf"[\[({{<][ \t]*\.|{_word}\.{_word}\.", low):
        return []
    out = []
    for run in DOTTED.finditer(low):
        at = run.start()
        for part in DOTTED_PART.finditer(low, run.start(), run.end()):
            word = part.group()
            if part.start() > at:
                out.append((at, part.start(), ""))
            new = str(DIGIT_WORDS.index(word)) if word in DIGIT_WORDS else word if word.isdigit() else "."
            if new != word:
                out.append((part.start(), part.end(), new))
            at = part.end()
    return out


def address_changes(low: str) -> list[tuple[int, int, str]]:
    """At and dot signs for their disguises, where an address stands around them. The plain word "at" counts only
    before a domain that spells or brackets a dot and ends in a known ending; after other signs any letters end it, but
    words after a plain address with a plain dot need a known ending too."""
    if "dot" not in low and not re.search(rf"{_open}(?:at|@|\.){_close}", low):
        return []
    out, after = [], 0
    for sign in AT.finditer(low):
        if sign.start() < after:
            continue
        changes, at, hidden, words, labels, last = [], sign.end(), 0, 0, 0, None
        while label := LABEL.match(low, at):
            labels, last, end = labels + 1, label, label.end()
            dot = DOT.match(low, end)
            if not dot or not LABEL.match(low, dot.end()):
                break
            if len(dot.group()) > 1:
                changes.append((dot.start(), dot.end(), "."))
                hidden += 1
                words += dot.group().strip() == "dot"
            at = dot.end()
            if ENDING.match(low, at) and not DOT.match(low, ENDING.match(low, at).end()):
                labels, last = labels + 1, ENDING.match(low, at)
                break
        plain_sign = sign.group() == "@"
        word_sign = sign.group().strip() == "at"
        known = word_sign or (plain_sign and words and hidden < labels - 1)
        if last is None or labels < 2 or not (ENDING if known else LETTERS).fullmatch(last.group()) or (plain_sign and not hidden) or (word_sign and not hidden):
            continue
        local = LOCAL_TAIL.search(low, max(after, sign.start() - 100), sign.start())
        if not local:
            continue
        before = []
        start = local.start()
        while dot := DOT_TAIL.search(low, max(after, start - 12), start):
            left = LOCAL_TAIL.search(low, max(after, dot.start() - 100), dot.start())
            if not left:
                break
            before.insert(0, (dot.start(), dot.end(), "."))
            start = left.start()
        out += before + ([] if plain_sign else [(sign.start(), sign.end(), "@")]) + changes
        after = last.end()
    return out


def deobfuscated(text: str) -> list[Rewritten]:
    """The rewriting steps, each on the text of the one before; none if the text hides nothing."""
    steps: list[Rewritten] = []
    for find, lower in ((look_changes, False), (spelled_changes, True), (dotted_changes, True), (address_changes, True)):
        current = steps[-1].text if steps else text
        low = current.lower() if lower else current
        if len(low) != len(current):  # a few characters grow in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in current)
        changes = find(low)
        if changes:
            steps.append(Rewritten(current, changes))
    return steps


def all_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The base spans, and base with disguised spans by kind, then start."""
    base = base_spans(text)
    steps = deobfuscated(text)
    if not steps:
        return base, base
    taken = {k: sorted((s, e) for kind, s, e in base if kind == k) for k in KINDS}
    found = list(base)
    for kind, start, end in base_spans(steps[-1].text):
        for step in reversed(steps):
            start, end = step.span(start, end)
        own = taken[kind]
        k = bisect_right(own, (start, float("inf")))
        if k and own[k - 1][1] >= end:
            continue
        found.append((kind, start, end))
    return base, sorted(found, key=lambda x: (KINDS.index(x[0]), x[1], x[2]))


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join([f"{k}:{s}:{e}" for k, s, e in spans])


REPORT = pa.schema([("doc_id", pa.int64()), ("n_email", pa.int64()), ("n_ip", pa.int64()), ("n_card", pa.int64()), ("n_phone", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])
REPORT_DDL = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def spans_of_documents(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the number of plain identifiers of each kind, the digest of their list, and all spans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for doc_id, text in values(batches, "doc_id", "text"):
                base, every = all_spans(text)
                kinds = [k for k, _, _ in base]
                yield (doc_id, *(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every))

        yield from in_batches(rows(), REPORT)

    return docs.select("doc_id", documents_text(docs).alias("text")).mapInArrow(run, REPORT_DDL)


def mask_text(text: str) -> str:
    """The text with each identifier, or run of overlapping ones, replaced by the name of its first kind."""
    _, spans = all_spans(text)
    if not spans:
        return text
    out, at, end, kind = [], 0, -1, ""
    for name, start, stop in sorted(spans, key=lambda x: (x[1], -x[2])):
        if start < end:
            end = max(end, stop)
            continue
        if kind:
            out.append(f"[{kind.upper()}]")
            at = end
        out.append(text[at:start])
        end, kind = stop, name
    out += [f"[{kind.upper()}]", text[end:]]
    return "".join(out)


def masked(docs: DataFrame) -> DataFrame:
    """The documents with masked texts and their new lengths; a null text stays null."""
    names = docs.columns
    schema = T.StructType([T.StructField("text", T.StringType()) if f.name == "text" else f for f in docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts = pa.array([None if t is None else mask_text(t) for t in batch.column(k).to_pylist()], batch.schema.field(k).type)
            yield batch.set_column(k, batch.schema.field(k), texts)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*names) if "n_chars" in names else out
