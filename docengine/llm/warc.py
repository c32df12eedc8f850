"""Derived WARC records.

A response record (a fetched page with its HTTP headers) gives two more: a metadata record with what the page says of
itself and a conversion record with its plain text.  Both refer to the response by its record id, repeat its target
URI and date, and carry digests of their own; the metadata also keeps the source's headers and digests and the id of
the conversion, so each of the three leads to the others.  Ids are made from the source's id, so a run that is
repeated gives the same records; a response's own id is made from its page, URI and payload digest.

Defined cases: a null page is a response with an empty body, which has an empty conversion; a null URI is written as
an empty one; equal rows give equal records; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import html
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docengine.llm.words import slices

FIELDS = "record_type string, record_id string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, source_payload_digest string, block binary"
SCHEMA = f"page_id long, {FIELDS}"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL name space of RFC 4122

#: Elements that end a line of text (a fixed list), and everything that is not text.
BREAKS = frozenset("address article aside blockquote br dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol option p pre section table tbody tfoot thead title td th tr ul".split())
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|</?([a-zA-Z][a-zA-Z0-9]*)[^<>]*>|<[!?/][^<>]*>", re.S | re.I)
BLANKS = re.compile(r"[ \t\r\f\v\xa0]+")
TITLE = re.compile(r"<title\b[^<>]*>", re.I)
TITLE_END = re.compile(r"</title", re.I)
LANGUAGE = re.compile(r"<html\b[^<>]*?\blang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
CHARSET = re.compile(r"<meta\b[^<>]*?\bcharset\s*=\s*[\"']?([A-Za-z0-9_-]+)", re.I)
LINK = re.compile(r"<a\b[^<>]*?\bhref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+))", re.I)


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(name: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, name)}>"


def plain_text(page: str) -> str:
    """The text that a reader sees: without scripts, styles, comments and tags, a line for each block."""
    raw = MARKUP.sub(lambda m: "\n" if (m[2] or "").lower() in BREAKS else "", page)
    lines = (BLANKS.sub(" ", x).strip() for x in html.unescape(raw).split("\n"))
    return "\n".join(x for x in lines if x)


def title(page: str) -> str:
    """What stands between the first title tag and the first end of one after it."""
    start = TITLE.search(page)
    end = TITLE_END.search(page, start.end()) if start else None
    return html.unescape(" ".join(page[start.end() : end.start()].split())) if end else ""


def response(page_id: int | None, url: str | None, page: str | None, date: str) -> dict:
    body = (page or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    return {
        "record_type": "response", "record_id": record_id(f"response/{page_id}/{url}/{digest(body)}"), "refers_to": None, "target_uri": url or "", "date": date,
        "content_type": "application/http; msgtype=response", "content_length": len(head) + len(body), "block_digest": digest(head + body),
        "source_payload_digest": digest(body), "block": head + body,
    }


def derive(source: dict) -> list[dict]:
    """The metadata and the conversion record of a response record."""
    head, _, body = source["block"].partition(b"\r\n\r\n")
    page = body.decode("utf-8", "replace")
    text = plain_text(page).encode()
    ids = {kind: record_id(f"{kind}/{source['record_id']}") for kind in ("metadata", "conversion")}
    first = lambda pattern: html.unescape(m[1]) if (m := pattern.search(page)) else ""
    links = [html.unescape(a or b or c) for a, b, c in LINK.findall(page)]
    fields = [
        ("source-record-id", source["record_id"]), ("source-content-type", source["content_type"]), ("source-block-digest", source["block_digest"]),
        ("source-payload-digest", source["source_payload_digest"]), ("conversion-record-id", ids["conversion"]),
        *(("source-http-header", x) for x in head.decode("latin-1").split("\r\n")),
        ("title", title(page)), ("language", first(LANGUAGE)), ("charset", first(CHARSET)), ("text-length", str(len(text))), *(("outlink", " ".join(x.split())) for x in links),
    ]
    about = "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    shared = {"refers_to": source["record_id"], "target_uri": source["target_uri"], "date": source["date"], "source_payload_digest": source["source_payload_digest"]}
    return [
        {"record_type": kind, "record_id": ids[kind], "content_type": content, "content_length": len(block), "block_digest": digest(block), "block": block} | shared
        for kind, content, block in (("metadata", "application/warc-fields", about), ("conversion", "text/plain; charset=utf-8", text))
    ]


def serialise(record: dict) -> bytes:
    """A record as it stands in a WARC file, a gzip member of its own."""
    named = [
        ("WARC-Type", record["record_type"]), ("WARC-Record-ID", record["record_id"]), ("WARC-Refers-To", record["refers_to"]), ("WARC-Target-URI", record["target_uri"]),
        ("WARC-Date", record["date"]), ("WARC-Block-Digest", record["block_digest"]), ("WARC-Source-Payload-Digest", record["source_payload_digest"]),
        ("Content-Type", record["content_type"]), ("Content-Length", str(record["content_length"])),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in named if v)
    return gzip.compress(head.encode() + b"\r\n" + record["block"] + b"\r\n\r\n", mtime=0)


class _Source:
    """The bytes of a WARC file, plain or gzipped by members, a few at a time."""

    def __init__(self, file: BinaryIO, size: int = 1 << 20):
        self.file, self.size, self.data, self.zipped, self.inner = file, size, bytearray(), None, None

    def more(self) -> bool:
        raw = self.file.read(self.size)
        if self.zipped is None:
            self.zipped = raw[:2] == b"\x1f\x8b"
        if not self.zipped:
            self.data += raw
            return bool(raw)
        while raw:
            self.inner = self.inner or zlib.decompressobj(31)
            self.data += self.inner.decompress(raw, 8 * self.size)
            while self.inner.unconsumed_tail:
                self.data += self.inner.decompress(self.inner.unconsumed_tail, 8 * self.size)
            raw, self.inner = (self.inner.unused_data, None) if self.inner.eof else (b"", self.inner)
            if not raw:
                return True
        return False

    def until(self, mark: bytes) -> bytes | None:
        """What stands before the mark; both are taken away."""
        at = 0
        while (stop := self.data.find(mark, at)) < 0:
            at = max(0, len(self.data) - len(mark) + 1)
            if not self.more():
                return None
        out = bytes(self.data[:stop])
        del self.data[: stop + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.data) < n and self.more():
            pass
        out = bytes(self.data[:n])
        del self.data[:n]
        return out


def parse(file: BinaryIO) -> Iterator[dict]:
    """Records of a WARC file one after another; no more than one is held at a time."""
    source = _Source(file)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "replace").strip().split("\r\n")
        h = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        block = source.take(int(h.get("content-length", 0)))
        source.take(4)
        payload = block.partition(b"\r\n\r\n")[2]
        yield {
            "record_type": h.get("warc-type"), "record_id": h.get("warc-record-id"), "refers_to": h.get("warc-refers-to"), "target_uri": h.get("warc-target-uri", ""),
            "date": h.get("warc-date"), "content_type": h.get("content-type"), "content_length": len(block), "block_digest": h.get("warc-block-digest") or digest(block),
            "source_payload_digest": h.get("warc-source-payload-digest") or h.get("warc-payload-digest") or digest(payload), "block": block,
        }


#: Files up to this many bytes come as one value from Spark's reader.
WHOLE = 1 << 27


def _records(file: BinaryIO) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0
    for record in parse(file):
        rows.append({"page_id": None} | record)
        size += len(record["block"])
        if len(rows) == 256 or size > 1 << 24:
            yield pa.RecordBatch.from_pylist(rows, ARROW)
            rows, size = [], 0
    yield pa.RecordBatch.from_pylist(rows, ARROW)


def read(spark: SparkSession, path: str, *, whole: int = WHOLE) -> DataFrame:
    """Records of WARC files, one row each; ``page_id`` is null.  Files of more than ``whole`` bytes are streamed, each by
    one task, so that a file may be larger than a task's memory, from any store that Arrow can open."""
    files = spark.read.format("binaryFile").load(path)

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for data in batch.column(0).to_pylist():
                yield from _records(io.BytesIO(data))

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, place = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with store.open_input_stream(place, compression=None) as file:
                    yield from _records(file)

    small = files.where(F.col("length") <= whole).select("content").mapInArrow(parsed, SCHEMA)
    return small.union(files.where(F.col("length") > whole).select("path").mapInArrow(streamed, SCHEMA))


ARROW = pa.schema([("page_id", pa.int64())] + [(n, {"long": pa.int64(), "binary": pa.binary()}.get(k, pa.string())) for n, k in (x.split() for x in FIELDS.split(", "))])


def responses(pages: DataFrame, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Response records of pages (``page_id``, ``url``, ``html``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_pylist([{"page_id": i} | response(i, u, h, date) for i, u, h in zip(*(c.to_pylist() for c in batch.columns))], ARROW)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, SCHEMA)


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and conversion records of all response records among ``records``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = [{"page_id": r["page_id"]} | d for r in batch.to_pylist() for d in derive(r)]
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    return records.where(F.col("record_type") == "response").mapInArrow(run, SCHEMA)


def derive_pages(pages: DataFrame, *, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """``derivatives(responses(pages))`` in one pass through Python."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = zip(*(c.to_pylist() for c in batch.columns))
            yield pa.RecordBatch.from_pylist([{"page_id": i} | d for i, u, h in rows for d in derive(response(i, u, h, date))], ARROW)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, SCHEMA)
