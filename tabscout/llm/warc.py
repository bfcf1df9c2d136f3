"""WARC archives: write them with an index first, then read selected records by coalesced byte ranges.

`write_archives` writes one gzip member per record into archive files of the shared folder and returns the index:
file, offset, length, url, digest and the rest of a record's identity. `read_records` takes index rows, sorts them by
file and offset, joins neighbouring ranges into one read each, and parses the records out of those ranges.

Defined cases: a null payload is an empty one; an empty table gives an empty index; repeated rows of one page are all
responses if they hold the largest id of their payload; a null id is smaller than any other; a null url leaves out the
target header; control characters in a url are percent-encoded. Further columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from tabscout.llm.common import in_batches, join_by_key, shared_folder, values

INDEX = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()),
    ("digest", pa.string()), ("record_type", pa.string()),
])
RECORDS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
])
INDEX_DDL = "file string, offset long, length long, page_id long, url string, digest string, record_type string"
RECORDS_DDL = "page_id long, url string, html string, payload_bytes long, payload_digest string, record_type string, refers_to long"
# Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
# A new archive file begins beyond this size; ranges closer than GAP are read at once, up to RANGE bytes.
FILE_BYTES, GAP, RANGE = 1 << 30, 1 << 16, 8 << 20


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a shared folder, as seen from a task, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def name_of(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def id_of(name: str | None) -> int | None:
    digits = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(digits) if digits else None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record as a gzip member. A revisit carries the HTTP head only; the head keeps the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name_of(page_id)}", f"WARC-Date: {DATE}",
        *([] if url is None else [f"WARC-Target-URI: {quote(url, safe=SAFE)}"]),
        f"WARC-Payload-Digest: sha1:{digest}",
        *([f"WARC-Refers-To: {name_of(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


# Everything printable stays as it is but the percent sign, so that unquote() is the exact inverse.
SAFE = "".join(chr(c) for c in range(33, 127) if chr(c) != "%")


def parse_record(member: bytes) -> tuple:
    """A record's row in the order of RECORDS; a payload is checked against its digest."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.startswith(b"Content-Length:")).split(b":")[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI")
    return (id_of(fields["WARC-Record-ID"]), None if url is None else unquote(url), None if revisit else payload.decode(), size, digest,
            fields["WARC-Type"], id_of(fields.get("WARC-Refers-To")) if revisit else None)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def base32(hex_digest: Column) -> Column:
    """Base32 of a hexadecimal SHA-1: five hex digits are four letters of five bits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for k in range(8):
        number = F.conv(F.substring(hex_digest, 5 * k + 1, 5), 16, 10).cast("int")
        parts += [F.substr(alphabet, F.shiftright(number, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write_archives(pages: DataFrame, folder: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) under the shared folder; returns the written index.

    Of rows with one payload of at least min_revisit_bytes, those with the largest id are responses and the others
    revisits of it. A task names its files anew at each attempt, so that what a lost attempt left is not in the index."""
    spark = pages.sparkSession
    text = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", text.alias("html"), base32(F.sha1(text.cast("binary"))).alias("digest"))
    last = rows.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
    rows = join_by_key(rows, last, "digest", "n")
    revisit = ~F.col("page_id").eqNullSafe(F.col("last")) & (F.octet_length("html") >= min_revisit_bytes)
    rows = rows.select("page_id", "url", "html", "digest", revisit.alias("revisit"), F.when(revisit, F.col("last")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)
        store.create_dir(path, recursive=True)

        def entries():
            out, at, name = None, 0, ""
            for page_id, url, html, digest, again, refers_to in values(batches, "page_id", "url", "html", "digest", "revisit", "refers_to"):
                if out is None or at >= FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{path}/{name}", compression=None)
                data = record_bytes(page_id, url, html.encode(), digest, refers_to, again)
                out.write(data)
                yield name, at, len(data), page_id, url, digest, "revisit" if again else "response"
                at += len(data)
            if out is not None:
                out.close()

        yield from in_batches(entries(), INDEX)

    rows.mapInArrow(write, INDEX_DDL).write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX_DDL).parquet(f"{folder}/index")


def read_records(index: DataFrame, folder: str, tasks: int | None = None) -> DataFrame:
    """The records of the given index rows: page_id, url, html (null for a revisit), payload_bytes, payload_digest,
    record_type, refers_to. Rows are dealt by ranges of (file, offset), so a task's reads go forward through a file."""
    tasks = tasks or int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_index = index.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = store_of(folder)

        def fetched(run: list[tuple]) -> Iterator[tuple]:
            name, start = run[0][:2]
            with store.open_input_file(f"{path}/{name}") as source:
                source.seek(start)
                data = source.read(run[-1][1] + run[-1][2] - start)
            for _, offset, length in run:
                yield parse_record(data[offset - start : offset - start + length])

        def records():
            run: list[tuple] = []
            for entry in values(batches, "file", "offset", "length"):
                if run and (entry[0] != run[0][0] or entry[1] - run[-1][1] - run[-1][2] > GAP or entry[1] + entry[2] - run[0][1] > RANGE):
                    yield from fetched(run)
                    run = []
                run.append(entry)
            if run:
                yield from fetched(run)

        yield from in_batches(records(), RECORDS, 200)

    return sorted_index.mapInArrow(read, RECORDS_DDL)


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the pages as archives in the shared folder and read every record back through the index."""
    folder = shared_folder(pages.sparkSession)
    return read_records(write_archives(pages, folder, min_revisit_bytes), folder)
