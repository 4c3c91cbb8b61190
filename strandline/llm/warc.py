"""WARC archives: a writer with revisit records and a sequential reader.

Each record is a gzip member of its own.  The reader goes through an archive once, in pieces of 64 KiB: members are
inflated as they come, records are framed by Content-Length, and block and payload digests are verified on the fly,
so memory does not depend on the size of a record or of an archive.

Archives are written by tasks into the shared folder under names of their own; the manifest that the write returns
names the archives of the tasks that succeeded, so what a lost executor left behind is never read.

Rows: a null page counts as empty, a null URL is written as none.  Of equal payloads of at least ``least`` bytes the record
with the largest page_id is the response, as are rows that repeat that page_id; where all ids of a group are null,
all are responses.  A null page_id is read back as null.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from .common import new_path, stage

LEAST = 1000
PIECE = 1 << 16
ARCHIVE = 1 << 28  # an archive is closed at this size
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = b"\r\n\r\n"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, serial: str) -> bytes:
    """One record as a gzip member.  A revisit has the HTTP head alone as its block."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    name = lambda *x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, ':'.join(map(str, x)))}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name('page', page_id) if refers_to is None and page_id is not None else name(serial)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~-._')}")
    if page_id is not None:
        lines.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name('page', refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(lines).encode() + END + block + END) + z.flush()


class Member:
    """One gzip member of a stream, inflated as it is read."""

    def __init__(self, source, rest: bytes):
        self.source, self.z, self.data, self.raw = source, zlib.decompressobj(31), b"", rest

    def more(self) -> bool:
        """Inflate another piece; false at the end of the member."""
        while not self.z.eof:
            raw = self.raw or self.source.read(PIECE)
            if not raw:
                raise ValueError("an archive ends within a record")
            piece = self.z.decompress(raw, PIECE)
            self.raw = self.z.unconsumed_tail
            if piece:
                self.data += piece
                return True
        return False

    def head(self) -> bytes:
        while (at := self.data.find(END)) < 0:
            if len(self.data) > 1 << 20 or not self.more():
                raise ValueError("a head without an end")
        out, self.data = self.data[:at], self.data[at + len(END) :]
        return out

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.data and not self.more():
                raise ValueError("a record is shorter than its Content-Length")
            piece, self.data = self.data[:n], self.data[n:]
            n -= len(piece)
            yield piece

    def close(self) -> bytes:
        """Check the end of the record and return the raw bytes after it."""
        while self.more():
            pass
        if self.data != END:
            raise ValueError("a record is longer than its Content-Length")
        return self.z.unused_data


def fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def read_records(source) -> Iterator[dict]:
    """The records of an archive in order, verified: fields, and digest and size of the payload."""
    rest = b""
    while rest or (rest := source.read(PIECE)):
        m = Member(source, rest)
        top = m.head()
        if not top.startswith(b"WARC/1."):
            raise ValueError("not a WARC record")
        f = fields(top)
        block, payload, size, http = hashlib.sha1(), hashlib.sha1(), 0, b""
        inside = False
        for piece in m.body(int(f["content-length"])):
            block.update(piece)
            if not inside:
                http += piece
                if (at := http.find(END)) < 0:
                    continue
                inside, piece, http = True, http[at + len(END) :], http[:at]
            payload.update(piece)
            size += len(piece)
        rest = m.close()
        hexed = lambda k: base64.b32decode(f[k].removeprefix("sha1:")).hex()
        if block.hexdigest() != hexed("warc-block-digest"):
            raise ValueError("a block does not match its digest")
        stated = hexed("warc-payload-digest")
        if f["warc-type"] == "response" and payload.hexdigest() != stated:
            raise ValueError("a payload does not match its digest")
        yield {"fields": f, "digest": stated, "bytes": size if f["warc-type"] == "response" else int(fields(http)["content-length"])}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def marked(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``pages(page_id, url, html)`` to (page_id, url, payload, refers_to)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.when(F.length("payload") >= least, F.sha1("payload")))
    groups = rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("sha", "first")
    rows = rows.join(groups, "sha", "left")
    return rows.select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = LEAST) -> DataFrame:
    """Write archives into ``folder``; returns the staged manifest (path, records, bytes)."""

    def run(batches):
        system, top = _open(folder)
        system.create_dir(top, recursive=True)
        out, done, serial = None, [], uuid.uuid4().hex
        for b in batches:
            for i, (page_id, url, payload, refers_to) in enumerate(zip(*(c.to_pylist() for c in b.columns))):
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, count = system.open_output_stream(posixpath.join(top, name), compression=None), 0
                out.write(record(page_id, url, payload, refers_to, f"{serial}:{name}:{count}"))
                count += 1
                if out.tell() >= ARCHIVE:
                    done.append((posixpath.join(folder, name), count, out.tell()))
                    out.close()
                    out = None
        if out is not None:
            done.append((posixpath.join(folder, name), count, out.tell()))
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "records", "bytes"])

    return stage(marked(pages, least).mapInArrow(run, "path string, records long, bytes long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """The records of the archives in a manifest: page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def run(batches):
        for b in batches:
            for path, stated in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                system, at = _open(path)
                rows = []
                with system.open_input_stream(at, compression=None) as source:
                    for r in read_records(source):
                        f = r["fields"]
                        number = lambda k: int(f[k]) if k in f else None
                        rows.append((number("page-id"), r["bytes"], r["digest"], f["warc-type"], number("refers-to-page-id")))
                if len(rows) != stated:
                    raise ValueError(f"{path} holds {len(rows)} records, not {stated}")
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    spread = manifest.select("path", "records").repartition(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write ``pages`` into archives in the shared folder and read them back."""
    return read_archives(write_archives(pages, new_path(pages.sparkSession, "warc"), least))
