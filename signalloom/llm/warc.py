"""WARC archives: one gzip member per record, written and read by Spark tasks.

Writing. Records whose payloads are equal and at least ``revisit_bytes`` long are one response, that with the largest
page_id, and revisits of it; a revisit carries the HTTP header of the full payload and no payload. Each task writes
archives of bounded size under names of its own attempt; only the names that finished tasks report count, so a lost
executor or a second attempt leaves no wrong records behind.

Reading. A reader streams an archive through an incremental zlib decompressor, one member after another, frames each
record by its Content-Length, and verifies block and payload digests. At most one record is held at a time.

Archives are opened with ``pyarrow.fs``, so they may lie in any store that it knows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pandas as pd
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalloom.llm.common import materialize, only, scratch_path

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
PAGE, REFERS_TO = "Page-ID", "Refers-To-Page-ID"
READ_BYTES = 1 << 16
READ_SCHEMA = (
    "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, "
    "payload binary"
)


class WarcError(ValueError):
    """An archive that does not follow the format, or a digest that does not match."""


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page/{page_id}')}>"


def _line(value: str) -> str:
    """A header value on one line; white space that would break the framing is percent-encoded."""
    return "".join(f"%{ord(c):02X}" if c in "\r\n\0" else c for c in value)


def make_record(page_id, url, html, refers_to, date: str) -> bytes:
    """One record, as a gzip member of its own."""
    payload = (html or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode() + (payload if refers_to is None else b"")
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", None if url is None else _line(url)),
        ("WARC-Payload-Digest", f"sha1:{hashlib.sha1(payload).hexdigest()}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("WARC-Profile", None if refers_to is None else REVISIT_PROFILE),
        ("WARC-Refers-To", None if refers_to is None else record_id(refers_to)),
        (PAGE, page_id),
        (REFERS_TO, refers_to),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    ]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    whole = VERSION + b"\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    return packer.compress(whole) + packer.flush()


def _headers(head: bytes) -> tuple[bytes, dict[str, str]]:
    first, *lines = head.split(b"\r\n")
    fields = {}
    for line in lines:
        name, colon, value = line.decode().partition(":")
        if not colon:
            raise WarcError(f"not a header line: {name!r}")
        fields[name.lower()] = value.strip()
    return first, fields


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one at a time."""
    rest = b""
    while True:
        data = rest or stream.read(READ_BYTES)
        if not data:
            return
        unpacker, parts = zlib.decompressobj(31), []
        while True:
            parts.append(unpacker.decompress(data))
            if unpacker.eof:
                break
            data = stream.read(READ_BYTES)
            if not data:
                raise WarcError("the last gzip member is cut off")
        rest = unpacker.unused_data
        yield b"".join(parts)


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(record headers, HTTP headers, payload) of one member, its length and digests verified."""
    head, gap, rest = member.partition(b"\r\n\r\n")
    version, fields = _headers(head)
    if not gap or not version.startswith(b"WARC/"):
        raise WarcError("a record does not start with its version")
    size = int(fields["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise WarcError("a record is not as long as its Content-Length")
    if fields["warc-block-digest"] != f"sha1:{hashlib.sha1(block).hexdigest()}":
        raise WarcError("a block digest does not match")
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = _headers(http_head)[1]
    if fields["warc-type"] != "revisit":
        if fields["warc-payload-digest"] != f"sha1:{hashlib.sha1(payload).hexdigest()}":
            raise WarcError("a payload digest does not match")
        if int(http["content-length"]) != len(payload):
            raise WarcError("a payload is not as long as its Content-Length")
    return fields, http, payload


def read_records(stream: BinaryIO) -> Iterator[dict]:
    number = lambda x: None if x is None else int(x)
    for member in members(stream):
        fields, http, payload = parse_record(member)
        yield {
            "page_id": number(fields.get(PAGE.lower())),
            "url": fields.get("warc-target-uri"),
            "record_type": fields["warc-type"],
            "payload_bytes": int(http["content-length"]),
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
            "refers_to": number(fields.get(REFERS_TO.lower())),
            "payload": payload,
        }


def with_referrals(pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """(page_id, url, html, refers_to): the page that a revisit refers to, null for a response.

    Payloads are equal if their SHA-256 and length are. Their largest page_id is found by a partial aggregate, so a
    group of copies meets no single task; the join back may be split by Spark. Shorter payloads, which refer to none, are
    spread by a hash of the whole row.
    """
    pages = only(pages, "page_id", "url", "html").withColumn("bytes", F.octet_length("html"))
    spread = F.hex(F.xxhash64("page_id", "url", "html"))
    keyed = pages.withColumn("key", F.when(F.col("bytes") >= revisit_bytes, F.sha2(F.col("html"), 256)).otherwise(spread))
    last = keyed.where(F.col("bytes") >= revisit_bytes).groupBy("key", "bytes")
    last = last.agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    found = keyed.join(last, ["key", "bytes"], "left")
    other = F.when(F.col("page_id").isNotNull() & (F.col("page_id") != F.col("last")), F.col("last"))
    return found.select("page_id", "url", "html", other.alias("refers_to"))


def write_warc(
    pages: DataFrame,
    folder: str,
    revisit_bytes: int = 1000,
    archive_bytes: int = 256 << 20,
    date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """Archive every row of pages(page_id, url, html) under folder; returns the manifest (path, records).

    A null html is an empty payload; null urls and page_ids leave their headers out, and a row without page_id is
    always a response. Rows that repeat a page_id with an equal payload are all responses if it is the largest of
    its payload. An empty table writes no archive. Other columns are ignored.
    """

    def write(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = pafs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        out, path, size, done, count = None, "", 0, [], 0
        try:
            for batch in batches:
                refers = batch["refers_to"].astype("Int64")
                ids = batch["page_id"].astype("Int64")
                for page, url, html, to in zip(ids, batch["url"], batch["html"], refers, strict=True):
                    if out is None:
                        path, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = store.open_output_stream(path)
                    page, to = (None if pd.isna(x) else int(x) for x in (page, to))
                    member = make_record(page, url, html, to, date)
                    out.write(member)
                    size, count = size + len(member), count + 1
                    if size >= archive_bytes:
                        out.close()
                        done.append((path, count))
                        out = None
            if out is not None:
                done.append((path, count))
        finally:
            if out is not None:
                out.close()
        yield pd.DataFrame(done, columns=["path", "records"])

    rows = with_referrals(pages, revisit_bytes)
    written = rows.mapInPandas(write, "path string, records long")
    return materialize(written, "manifest")


def read_warc(manifest: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records of the manifest's archives (READ_SCHEMA, the payload on demand), in any order."""
    names = READ_SCHEMA if with_payload else READ_SCHEMA.rpartition(",")[0]

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = pafs.FileSystem.from_uri(folder)[0]
        columns = [x.split()[0] for x in names.split(", ")]
        for batch in batches:
            for path in batch["path"]:
                with store.open_input_stream(path) as stream:
                    rows, size = [], 0
                    for row in read_records(stream):
                        rows.append([row[c] for c in columns])
                        size += len(row["payload"]) if with_payload else 256
                        if size >= 8 << 20:
                            yield _frame(rows, columns)
                            rows, size = [], 0
                    yield _frame(rows, columns)

    spread = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return spread.mapInPandas(read, names)


def _frame(rows: list[list], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns, dtype=object)
    return out.astype({c: "Int64" for c in ("page_id", "payload_bytes", "refers_to")})


def archive_and_read(spark: SparkSession, pages: DataFrame, revisit_bytes: int = 1000) -> DataFrame:
    """Write pages to archives in the shared scratch folder and read them back."""
    folder = scratch_path(spark, "warc")
    return read_warc(write_warc(pages, folder, revisit_bytes), folder)
