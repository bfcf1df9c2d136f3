"""Archives: what was written comes back, through the index and by other readers."""

import base64
import gzip
import hashlib
from pathlib import Path

from tabscout.llm import warc
from tabscout.llm.common import shared_folder


def expected(rows, least=0):
    last = {}
    for page, _, html in rows:
        key = html or ""
        last[key] = max([x for x in (last.get(key), page) if x is not None], default=None)
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        revisit = page != last[html or ""] and len(data) >= least
        out.append((str(page), len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[html or ""] if revisit else None))
    return sorted(out, key=str)


def back(df):
    return sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    rows = [(r.page_id, r.url, r.html) for r in pages.collect()]
    out = warc.round_trip(pages)
    assert back(out) == expected(rows)
    html = {r.page_id: (r.url, r.html) for r in out.collect() if r.record_type == "response"}
    assert all(html[p] == (u, h or "") for p, u, h in rows if p in html)


def test_odd_rows_and_index(spark):
    same = "copy of a page" * 100
    rows = [(1, "http://a/ b\r\nX: y%41é", same), (2, None, same), (3, "u", None), (4, "u", ""), (None, "u", same), (5, "u", "é\r\n\r\nWARC/1.1"), (6, "u", "w" * 3_000_000), (9, "u", same), (9, "u", same)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as offset").repartition(3)
    assert back(warc.round_trip(pages)) == expected(rows)
    assert back(warc.round_trip(pages, 2000)) == expected(rows, 2000)
    assert warc.round_trip(pages.limit(0)).count() == 0
    folder = shared_folder(spark)
    index = warc.write_archives(pages, folder)
    wanted = index.filter("page_id in (1, 6)")
    assert {(r.page_id, r.url) for r in warc.read_records(wanted, folder, tasks=2).collect()} == {(1, rows[0][1]), (6, "u")}
    # Each entry names one gzip member; a file as a whole is a series of records.
    store, path = warc.store_of(folder)
    entries = index.collect()
    for name in {e.file for e in entries}:
        data = Path(path, name).read_bytes()
        own = sorted((e for e in entries if e.file == name), key=lambda e: e.offset)
        assert [e.offset for e in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        text = gzip.decompress(data)
        assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Record-ID: ") == len(own)


def test_hot_payload(spark):
    """One payload in most rows: its group is matched without a task that holds it."""
    pages = spark.range(5000).selectExpr("id as page_id", "concat('u', id) as url", "if(id % 3 > 0, 'same', concat('own', id)) as html")
    out = back(warc.round_trip(pages))
    assert out == expected([(r.page_id, r.url, r.html) for r in pages.collect()])
