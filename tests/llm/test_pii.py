"""Plain identifiers against the patterns as given, disguised ones against planted texts."""

import hashlib
import random
import re
import time

import pytest

from tabscout.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def checks(kind, text):
    digits = [c for c in text if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in text.split("."))
    if kind == "card":
        even = sum(int(c) for c in digits[-1::-2])
        odd = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
        return 13 <= len(digits) <= 19 and (even + odd) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in (("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE)) for m in p.finditer(text) if checks(k, m.group())]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(3)
    parts = ["a", "b.c", "@", "x@y.z", ".", "1", "25", "255", "4111 1111 1111 1111", "4111-1111-1111-1111", "+1 (415) 555-0101", "+", " ", "-", "é", "\n", "10.0.0.1", "256"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))
        assert pii.base_spans(text) == brute(text), text
        base, every = pii.all_spans(text)
        assert set(base) <= set(every)


@pytest.mark.parametrize("text,kind,found", [
    ("write to jane [at] example [dot] org now", "email", "jane [at] example [dot] org"),
    ("write to jane dot doe at example dot com now", "email", "jane dot doe at example dot com"),
    ("mail jаne@exаmple.com", "email", "jаne@exаmple.com"),
    ("mail jane＠example．com!", "email", "jane＠example．com"),
    ("mail ja​ne@exam​ple.com", "email", "ja​ne@exam​ple.com"),
    ("jane(at)mail.example.org", "email", "jane(at)mail.example.org"),
    ("card four one one one one one one one one one one one one one one one end", "card", "four one one one one one one one one one one one one one one one"),
    ("card ４１１１ １１１１ １１１１ １１１１ end", "card", "４１１１ １１１１ １１１１ １１１１"),
    ("host one nine two dot one six eight dot one dot one zero up", "ip", "one nine two dot one six eight dot one dot one zero"),
    ("call plus one four one five five five five zero one zero one", "phone", "plus one four one five five five five zero one zero one"),
    ("É 10․0․0․1 x", "ip", "10․0․0․1"),
])
def test_disguises_map_back_to_the_source(text, kind, found):
    base, every = pii.all_spans(text)
    assert (kind, text.index(found), text.index(found) + len(found)) in every
    assert found not in pii.mask_text(text)


@pytest.mark.parametrize("text", [
    "look at the dot on the map", "visit us at example.com today", "she met him at one dot two three", "one two or three at four", "we were at home. Then we left",
    "Привет, как дела? До встречи в два.", "at dot com they said", "",
])
def test_ordinary_text_is_left_alone(text):
    assert pii.all_spans(text) == ([], [])
    assert pii.mask_text(text) == text


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" + "(" * 300_000, "one " * 80_000, " at " * 80_000, "a dot " * 50_000, "а" * 200_000])
def test_long_runs_take_linear_time(text):
    start = time.process_time()
    pii.all_spans(text)
    assert time.process_time() - start < 5


def test_query_columns_and_odd_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.co and 1.2.3.4", "x"), (3, "a@b.co and 1.2.3.4", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = sorted(tuple(r) for r in pii.spans_of_documents(docs).collect())
    empty = hashlib.sha256(b"").hexdigest()
    spans = "email:0:6,ip:11:18"
    assert out[:2] == [(1, 0, 0, 0, 0, empty, ""), (2, 0, 0, 0, 0, empty, "")]
    assert out[2] == out[3] == (3, 1, 1, 0, 0, hashlib.sha256(spans.encode()).hexdigest(), spans)
    assert pii.spans_of_documents(docs.limit(0)).count() == 0
    kept = {r["doc_id"]: r["text"] for r in pii.masked(docs).collect()}
    assert kept == {1: None, 2: "", 3: "[EMAIL] and [IP]"}


@pytest.mark.parametrize("address", ["j\u0430ne@example.com", "jane@example.c\u043em", "ja\u200bne@example.com", "jane@example.c\u200bom", "jane\uff0edoe@example.com"])
def test_disguise_in_one_part_of_an_address(address):
    """A rest of the address is a plain identifier itself; the whole one is found beside it."""
    text = f"mail {address} now"
    base, every = pii.all_spans(text)
    assert base and set(base) < set(every)
    assert ("email", 5, 5 + len(address)) in every
    assert pii.mask_text(text) == "mail [EMAIL] now"


@pytest.mark.parametrize("kind,found", [
    ("email", "jane [at] firma [dot] nl"), ("email", "jane (at) azienda (dot) it"), ("email", "jane [at] firma dot pl"), ("email", "jane@firma[dot]jp"), ("email", "jane @ firma dot ca".replace(" @ ", "@")),
    ("ip", "10[.]0[.]0[.]1"), ("ip", "192 dot 168 dot 1 dot 1"), ("ip", "10 (dot) 0 (dot) 0 (dot) 1"), ("ip", "one dot two dot three dot four"), ("ip", "10.0 dot zero[.]one nine"),
])
def test_disguises_beyond_known_endings_and_digit_words(kind, found):
    text = f"see {found} now"
    assert (kind, 4, 4 + len(found)) in pii.all_spans(text)[1]
    assert pii.mask_text(text) == f"see [{kind.upper()}] now"


@pytest.mark.parametrize("text", ["see us at firma dot nl", "jane at firma dot nl", "300 dot 1 dot 1 dot 1", "one dot two dot three", "version 1 dot 2 dot 3"])
def test_weak_disguises_are_left_alone(text):
    assert pii.mask_text(text) == text


@pytest.mark.parametrize("text", ["1 dot " * 50_000, "1[.]" * 75_000, "one." * 75_000 + " dot", "dot " + "one one " * 40_000])
def test_long_dotted_runs_take_linear_time(text):
    start = time.process_time()
    pii.all_spans(text)
    assert time.process_time() - start < 5
