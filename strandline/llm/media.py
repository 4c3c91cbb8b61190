"""Media columns with content-defined payload chunking.

A text becomes a binary PGM image: 8-bit samples, 24 to a row, padded with 255 to whole
24 x 24 frames.  The file is cut where a rolling gear hash of the last 32 bytes has its top bits
zero, chunks are known by their SHA-256, equal chunks are stored once in a table bucketed by digest, and
an ordered list of digests stands for each file.  Reading joins the lists with the store, puts
the chunks in order, and verifies each chunk's and each file's digest before features are computed.

Rows: a null text counts as empty; an empty text is one frame of padding.  Equal texts share one
stored file, read back once.  A null or repeated doc_id is kept as it is.  An empty table gives no rows.
"""

from __future__ import annotations

import bz2
import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import CLEANUP, stage

SIDE = 24
FRAME = SIDE * SIDE
PAD = b"\xff"
LEAST, TOP_BITS, MOST = 1024, 12, 32768
#: A digest with at least so many uses may be hot; so many digests at most are.
HOT, HOT_DIGESTS = 100, 256
GEAR = np.random.default_rng(20).integers(0, 1 << 32, 256, dtype=np.uint32)


def encode(data: bytes) -> bytes:
    """The PGM file of a payload's bytes before padding."""
    frames = max(1, -(-len(data) // FRAME))
    return b"P5\n# bytes=%d\n%d %d\n255\n" % (len(data), SIDE, frames * SIDE) + data + PAD * (frames * FRAME - len(data))


def decode(media: bytes) -> tuple[int, bytes]:
    """(bytes before padding, payload) of a PGM file."""
    m = re.match(rb"P5\n# bytes=(\d+)\n(\d+) (\d+)\n255\n", media)
    if not m or len(media) != m.end() + int(m[2]) * int(m[3]):
        raise ValueError("not a media file of this store")
    return int(m[1]), media[m.end() :]


def cut_points(data: bytes) -> list[int]:
    """The ends of the chunks of ``data``."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    for k in (1, 2, 4, 8, 16):
        more = h.copy()
        more[k:] += h[:-k] << np.uint32(k)
        h = more
    ends, start = [], 0
    for p in (np.flatnonzero(h < np.uint32(1 << (32 - TOP_BITS))) + 1).tolist() + [len(data)]:
        while p - start > MOST:
            start += MOST
            ends.append(start)
        if p - start >= LEAST or p == len(data) and p > start:
            ends.append(p)
            start = p
    return ends


def chunks(data: bytes) -> list[bytes]:
    ends = cut_points(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def feature(payload: bytes) -> str:
    """Mean, deviation and an 8 x 8 average hash of the mean frame."""
    x = np.frombuffer(payload, np.uint8)
    small = x.reshape(-1, SIDE, SIDE).sum(0, dtype=np.int64).reshape(8, 3, 8, 3).sum((1, 3))
    bits = np.packbits(small.ravel() * small.size > small.sum()).tobytes().hex()
    return f"mean={x.mean():.4f};std={x.std():.4f};ahash={bits}"


def recipes(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to (doc_id, media_sha, chunks), the digests in order."""

    def run(batches):
        for b in batches:
            shas, lists = [], []
            for data in b.column(1).to_pylist():
                media = encode(data)
                shas.append(hashlib.sha256(media).digest())
                lists.append([hashlib.sha256(c).digest() for c in chunks(media)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shas, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], ["doc_id", "media_sha", "chunks"])

    return _bytes(docs).mapInArrow(run, "doc_id long, media_sha binary, chunks array<binary>")


def chunk_rows(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to (digest, data), the data compressed; equal chunks of a batch once."""

    def run(batches):
        for b in batches:
            seen, rows, held = set(), [], 0
            for data in b.column(1).to_pylist():
                for c in chunks(encode(data)):
                    if (d := hashlib.sha256(c).digest()) not in seen:
                        seen.add(d)
                        rows.append((d, bz2.compress(c)))
                        held += len(rows[-1][1])
                if held > 1 << 23:
                    yield _pairs(rows)
                    rows, held = [], 0
            if rows:
                yield _pairs(rows)

    return _bytes(docs).mapInArrow(run, "digest binary, data binary")


def _pairs(rows):
    return pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in zip(*rows)], ["digest", "data"])


def _bytes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("data"))


def store_name() -> str:
    return f"strandline_chunks_{uuid.uuid4().hex}"


def write_store(docs: DataFrame, name: str | None = None) -> DataFrame:
    """Write each distinct chunk once, bucketed by digest, into a table of the warehouse, and read it back."""
    spark = docs.sparkSession
    name = name or store_name()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    once = chunk_rows(docs).groupBy("digest").agg(F.first("data").alias("data")).repartition(n, "digest")
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        once.write.option("compression", "uncompressed").bucketBy(n, "digest").saveAsTable(name)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.table(name)


def fetched(ordered: DataFrame, store: DataFrame) -> DataFrame:
    """``ordered(digest, ...)`` with the chunks of their digests.

    The store is bucketed and is not shuffled, so AQE cannot split a digest that very many files share.  Digests with
    over a 256th of all places, of which there are at most 256 of MOST bytes each, are therefore broadcast.
    """
    uses = ordered.groupBy("digest").agg(F.count("*").alias("uses"))
    uses = stage(uses.where(F.col("uses") >= HOT), "uses")
    least = max(HOT, -(-ordered.count() // HOT_DIGESTS))
    hot = stage(store.join(F.broadcast(uses.where(F.col("uses") >= least)), "digest", "left_semi"), "hot")
    known = F.broadcast(hot.select("digest"))
    return ordered.join(known, "digest", "left_anti").join(store, "digest").unionByName(ordered.join(F.broadcast(hot), "digest"))


def read_media(lists: DataFrame, store: DataFrame) -> DataFrame:
    """``lists(media_sha, chunks)``, distinct, to verified (media_sha, values read back)."""
    ordered = lists.select("media_sha", F.size("chunks").alias("n"), F.posexplode("chunks").alias("pos", "digest"))
    found = fetched(ordered, store).select("media_sha", "n", F.struct("pos", "digest", "data").alias("part"))
    # A file of one chunk is whole where the join finds it; only the others move once more.
    whole = found.where("n = 1").select("media_sha", "n", F.array("part").alias("parts"))
    several = found.where("n > 1").groupBy("media_sha").agg(F.max("n").alias("n"), F.sort_array(F.collect_list("part")).alias("parts"))
    whole = whole.unionByName(several)

    def run(batches):
        for b in batches:
            out = []
            for sha, n, parts in zip(*(c.to_pylist() for c in b.columns)):
                got = []
                for p in parts:
                    c = bz2.decompress(p["data"])
                    if hashlib.sha256(c).digest() != p["digest"]:
                        raise ValueError("a stored chunk is damaged")
                    got.append(c)
                media = b"".join(got)
                if len(got) != n or hashlib.sha256(media).digest() != sha:
                    raise ValueError("a stored file is damaged")
                size, payload = decode(media)
                out.append((sha, size, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), sha.hex(), feature(payload)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), _KINDS)], _NAMES)

    return whole.mapInArrow(run, "media_sha binary, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


_NAMES = ["media_sha", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_KINDS = [pa.binary(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]


def media_columns(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to a row per document with what was read back for it.  The store goes afterwards."""
    lists = stage(recipes(docs), "recipes")
    name = store_name()
    try:
        store = write_store(docs, name)
        once = stage(lists.select("media_sha", "chunks").dropDuplicates(["media_sha"]), "lists")
        values = stage(read_media(once, store), "media")
    finally:
        docs.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
    return lists.select("doc_id", "media_sha").join(values, "media_sha").drop("media_sha")
