"""BAM and BAI: coordinate-sorted binary alignments and their index.

Records are range-partitioned by coordinate; each partition writes its own run of BGZF blocks as a part file in the
shared folder, and reports each record's place within it.  Sizes of the parts, summed in order, turn these into virtual offsets, from
which the index tables are built by aggregation.  Joining the parts into one file copies bytes and keeps nothing in memory.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import sequence as S
from .sequences import open_path
from .staging import staged

BLOCK = 0xFF00
#: Fixed by the BAM format.
EOF = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
NIBBLES = "=ACMGRSVTWYHKDBN"
WINDOW = 1 << 14


def block(data: bytes) -> bytes:
    """One BGZF block."""
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = z.compress(data) + z.flush()
    head = struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


class BlockWriter:
    """A stream of BGZF blocks; ``tell`` gives (compressed place of the block, place in it)."""

    def __init__(self, out):
        self.out, self.data, self.done = out, b"", 0

    def tell(self) -> tuple[int, int]:
        return self.done, len(self.data)

    def write(self, data: bytes) -> None:
        if self.data and len(self.data) + len(data) > BLOCK:
            self.flush()
        while len(data) > BLOCK:  # a record longer than a block goes over several
            self.data, data = data[:BLOCK], data[BLOCK:]
            self.flush()
        self.data += data

    def flush(self) -> None:
        if self.data:
            b = block(self.data)
            self.out.write(b)
            self.done += len(b)
            self.data = b""


def read_blocks(source) -> bytes:
    """Inflate BGZF blocks one after another."""
    while head := source.read(18):
        size = struct.unpack("<H", head[16:18])[0] + 1
        rest = source.read(size - 18)
        data = zlib.decompress(rest[:-8], -15)
        crc, n = struct.unpack("<II", rest[-8:])
        if zlib.crc32(data) != crc or len(data) != n:
            raise ValueError("a damaged BGZF block")
        yield data


def cigar_ops(text: str) -> list[tuple[int, str]]:
    out, n = [], 0
    for c in text if text and text != "*" else "":
        if c.isdigit():
            n = 10 * n + int(c)
        else:
            out.append((n, c))
            n = 0
    return out


def encode_tag(tag: str) -> bytes:
    name, kind, value = tag.split(":", 2)
    head = name.encode() + kind.encode()
    if kind == "i":
        return head + struct.pack("<i", int(value))
    if kind == "f":
        return head + struct.pack("<f", float(value))
    return head + value.encode() + (b"" if kind == "A" else b"\0")


def encode_record(ref: int, pos: int, mapq: int, bin_: int, flag: int, mate_ref: int, mate_pos: int, tlen: int, name: str, cigar: str, seq: str, qual: str, tags: list[str]) -> bytes:
    """A record with its length before it, as the format has it."""
    ops = cigar_ops(cigar)
    seq = "" if seq in (None, "*") else seq
    codes = [max(NIBBLES.find(c), 0) if c != "N" else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2]))
    quals = b"\xff" * len(seq) if qual in (None, "*", "") or len(qual) != len(seq) else bytes(ord(c) - 33 for c in qual)
    body = struct.pack("<iiBBHHHIiii", ref, pos, len(name) + 1, mapq, bin_, len(ops), flag, len(seq), mate_ref, mate_pos, tlen)
    body += name.encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | S.OPS.index(c)) for n, c in ops) + packed + quals + b"".join(map(encode_tag, tags))
    return struct.pack("<I", len(body)) + body


def decode_record(body: bytes) -> dict:
    ref, pos, n_name, mapq, bin_, n_ops, flag, n_seq, mate_ref, mate_pos, tlen = struct.unpack_from("<iiBBHHHIiii", body)
    at = 32
    name, at = body[at : at + n_name - 1].decode(), at + n_name
    ops = struct.unpack_from(f"<{n_ops}I", body, at)
    at += 4 * n_ops
    packed, at = body[at : at + (n_seq + 1) // 2], at + (n_seq + 1) // 2
    seq = "".join(NIBBLES[b >> 4] + NIBBLES[b & 15] for b in packed)[:n_seq]
    raw, at = body[at : at + n_seq], at + n_seq
    tags = []
    while at < len(body):
        key, kind, at = body[at : at + 2].decode(), chr(body[at + 2]), at + 3
        if kind == "Z":
            end = body.index(b"\0", at)
            value, at = body[at:end].decode(), end + 1
        elif kind == "A":
            value, at = chr(body[at]), at + 1
        else:
            value, at = str(struct.unpack_from("<i" if kind == "i" else "<f", body, at)[0]), at + 4
        tags.append(f"{key}:{kind}:{value}")
    qual = "*" if not n_seq or raw == b"\xff" * n_seq else "".join(chr(b + 33) for b in raw)
    return dict(ref=ref, pos=pos, mapq=mapq, bin=bin_, flag=flag, mate_ref=mate_ref, mate_pos=mate_pos, tlen=tlen, name=name, cigar="".join(f"{v >> 4}{S.OPS[v & 15]}" for v in ops) or "*", seq=seq or "*", qual=qual, tags=tags)


def projected(records: DataFrame, refs: DataFrame) -> DataFrame:
    """Records with the numbers of a BAM: contig and mate contig by index, 0-based start and end, bin."""
    r = refs.select("name", F.col("ref_id").cast("int").alias("index_"))
    own, mate = r.toDF("rname", "ref_idx"), r.toDF("mate_name_", "mate_idx")
    out = records.join(own, "rname", "left").withColumn("mate_name_", F.when(F.col("rnext") == "=", F.col("rname")).otherwise(F.col("rnext"))).join(mate, "mate_name_", "left").drop("mate_name_")
    span = F.greatest(F.lit(1), S.reference_span(S.parse_cigar("cigar")))
    out = out.withColumn("ref_idx", F.coalesce("ref_idx", F.lit(-1))).withColumn("mate_idx", F.coalesce("mate_idx", F.lit(-1)))
    out = out.withColumn("pos0", F.col("pos") - 1).withColumn("end0", F.when(F.col("ref_idx") >= 0, F.col("pos") - 1 + span).otherwise(F.col("pos0")))
    return out.withColumn("bin", F.when(F.col("ref_idx") >= 0, S.reg2bin("pos0", F.greatest(F.col("end0"), F.col("pos0") + 1))).otherwise(F.lit(4680)))


def coordinate_key() -> list[Column]:
    """Contigs in order, then positions; unplaced records last."""
    return [(F.col("ref_idx") < 0).cast("int"), F.col("ref_idx"), F.col("pos0")]


PLACES = "part int, n long, ref_idx int, pos0 int, end0 int, bin int, block long, inside int"


def write_parts(records: DataFrame, refs: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Write sorted records as part files; returns the staged places of the records, and of the end of each part."""
    p = projected(records, refs)
    keys = coordinate_key()
    p = p.repartitionByRange(partitions, *keys) if partitions else p.repartitionByRange(*keys)
    tie = [c for c in ("name", "flag", "cigar") if c in p.columns]
    p = p.sortWithinPartitions(*keys, *tie)
    cols = ["ref_idx", "pos0", "end0", "bin", "mapq", "flag", "mate_idx", "pnext", "tlen", "name", "cigar", "seq", "qual", "tags"]

    def run(batches):
        from pyspark import TaskContext

        part, n, out = TaskContext.get().partitionId(), 0, None
        system, top = open_path(folder)
        system.create_dir(top, recursive=True)
        own = posixpath.join(top, f"part-{part:06d}-{uuid.uuid4().hex}.bgzf")
        with system.open_output_stream(own, compression=None) as f:
            out = BlockWriter(f)
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    data = encode_record(r["ref_idx"], r["pos0"], r["mapq"], r["bin"], r["flag"], r["mate_idx"], r["pnext"] - 1, r["tlen"], r["name"], r["cigar"], r["seq"], r["qual"], r["tags"])
                    if out.data and len(out.data) + len(data) > BLOCK:
                        out.flush()
                    rows.append((part, n, r["ref_idx"], r["pos0"], r["end0"], r["bin"], *out.tell(), None))
                    out.write(data)
                    n += 1
                if rows:
                    yield _places(rows)
            out.flush()
            yield _places([(part, n, None, None, None, None, out.done, 0, posixpath.basename(own))])

    return staged(p.select(*cols).mapInArrow(run, PLACES + ", file string"))


def _places(rows):
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["part", "n", "ref_idx", "pos0", "end0", "bin", "block", "inside", "file"])


def header_bytes(refs: DataFrame, text: str) -> bytes:
    """The header of a BAM.  Contigs are read one after another, as the header itself must list them."""
    names = [(r["name"], r["length"]) for r in refs.orderBy("ref_id").select("name", "length").toLocalIterator()]
    out = b"BAM\1" + struct.pack("<I", len(text)) + text.encode() + struct.pack("<I", len(names))
    return out + b"".join(struct.pack("<I", len(n) + 1) + n.encode() + b"\0" + struct.pack("<I", size) for n, size in names)


def virtual_offsets(places: DataFrame, head: int) -> DataFrame:
    """(ref_idx, pos0, end0, bin, beg, end): each record with the virtual offsets of itself and of the next one."""
    ends = places.where("file is not null").select("part", F.col("block").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = ends.select("part", (F.coalesce(F.sum("size").over(before), F.lit(0)) + head).alias("base"))
    v = places.join(base, "part").withColumn("beg", (F.col("base") + F.col("block")) * 65536 + F.col("inside"))
    after = Window.partitionBy("part").orderBy("n")
    v = v.withColumn("end", F.lead("beg").over(after))
    return v.where("file is null").select("part", "n", "ref_idx", "pos0", "end0", "bin", "beg", "end")


def index_bins(v: DataFrame) -> DataFrame:
    """(ref_idx, bin, beg, end): runs of records that follow each other in the file, as chunks of their bins."""
    order = Window.partitionBy("ref_idx", "bin").orderBy("beg")
    placed = v.where("ref_idx >= 0").withColumn("fresh_", F.coalesce((F.lag("end").over(order) != F.col("beg")).cast("int"), F.lit(1)))
    placed = placed.withColumn("run_", F.sum("fresh_").over(order))
    return placed.groupBy("ref_idx", "bin", "run_").agg(F.min("beg").alias("beg"), F.max("end").alias("end")).drop("run_")


def index_linear(v: DataFrame) -> DataFrame:
    """(ref_idx, win, off): the first offset of each window of 16 kb, windows without records taking the next one's."""
    placed = v.where("ref_idx >= 0")
    last = F.shiftright(F.greatest(F.col("end0"), F.col("pos0") + 1) - 1, 14)
    hit = placed.select("ref_idx", F.explode(F.sequence(F.shiftright("pos0", 14), last)).alias("win"), "beg").groupBy("ref_idx", "win").agg(F.min("beg").alias("off"))
    order = Window.partitionBy("ref_idx").orderBy("win")
    known = hit.withColumn("from_", F.coalesce(F.lag("win").over(order) + 1, F.lit(0)))
    return known.select("ref_idx", F.explode(F.sequence("from_", "win")).alias("win"), "off")


def unplaced(v: DataFrame) -> DataFrame:
    return v.agg(F.count_if(F.col("ref_idx") < 0).cast("long").alias("n_no_coor"))


def write_index(v: DataFrame, n_refs: int, path: str) -> None:
    """The BAI file, contig by contig."""
    bins, linear, out = {}, {}, [b"BAI\1", struct.pack("<I", n_refs)]
    for r in index_bins(v).orderBy("ref_idx", "bin", "beg").toLocalIterator():
        bins.setdefault(r["ref_idx"], {}).setdefault(r["bin"], []).append((r["beg"], r["end"]))
    for r in index_linear(v).orderBy("ref_idx", "win").toLocalIterator():
        linear.setdefault(r["ref_idx"], []).append(r["off"])
    for i in range(n_refs):
        b = bins.get(i, {})
        out.append(struct.pack("<I", len(b)))
        for k, c in b.items():
            out.append(struct.pack("<II", k, len(c)) + b"".join(struct.pack("<QQ", *x) for x in c))
        w = linear.get(i, [])
        out.append(struct.pack(f"<I{len(w)}Q", len(w), *w))
    out.append(struct.pack("<Q", unplaced(v).first()[0]))
    system, at = open_path(path)
    with system.open_output_stream(at, compression=None) as f:
        f.write(b"".join(out))


def write_bam(records: DataFrame, refs: DataFrame, path: str, text: str, partitions: int | None = None) -> DataFrame:
    """One BAM at ``path`` and its index beside it; returns the virtual offsets of the records."""
    folder = f"{path}.parts"
    places = write_parts(records, refs, folder, partitions)
    data = header_bytes(refs, text)
    head = b"".join(block(data[i : i + BLOCK]) for i in range(0, len(data), BLOCK))
    names = [r["file"] for r in places.where("file is not null").orderBy("part").select("file").toLocalIterator()]
    system, at = open_path(path)
    _, top = open_path(folder)
    with system.open_output_stream(at, compression=None) as out:
        out.write(head)
        for n in names:
            with system.open_input_stream(posixpath.join(top, n), compression=None) as source:
                while piece := source.read(1 << 20):
                    out.write(piece)
        out.write(EOF)
    system.delete_dir(top)
    v = virtual_offsets(places, len(head))
    last = Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)
    ends = v.groupBy("part").agg(F.min("beg").alias("first")).withColumn("next_", F.min("first").over(last)).select("part", "next_")
    size = system.get_file_info(at).size - len(EOF)
    v = v.join(ends, "part").withColumn("end", F.coalesce("end", "next_", F.lit(size * 65536))).drop("next_")
    v = staged(v)
    write_index(v, refs.count(), f"{path}.bai")
    return v


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Records of a BAM in file order; a file is a task, read block by block."""
    kinds = "n long, ref int, pos int, mapq int, bin int, flag int, mate_ref int, mate_pos int, tlen int, name string, cigar string, seq string, qual string, tags array<string>"

    def run(batches):
        for b in batches:
            for one in b.column(0).to_pylist():
                system, at = open_path(one)
                with system.open_input_stream(at, compression=None) as source:
                    yield from _decoded(read_blocks(source))

    return spark.createDataFrame([(path,)], "path string").mapInArrow(run, kinds)


def _decoded(blocks):
    data = bytearray()

    def need(n):
        while len(data) < n:
            piece = next(blocks, None)
            if piece is None:
                return False
            data.extend(piece)
        return True

    def take(n):
        if not need(n):
            raise ValueError("a BAM ends within a record")
        out = bytes(data[:n])
        del data[:n]
        return out

    if take(4) != b"BAM\1":
        raise ValueError("not a BAM")
    take(struct.unpack("<I", take(4))[0])
    for _ in range(struct.unpack("<I", take(4))[0]):
        take(struct.unpack("<I", take(4))[0] + 4)
    rows, n = [], 0
    while need(4):
        rows.append({"n": n} | decode_record(take(struct.unpack("<I", take(4))[0])))
        n += 1
        if len(rows) == 4096:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows):
    i, s = pa.int32(), pa.string()
    kinds = pa.schema([("n", pa.int64()), *((c, i) for c in ("ref", "pos", "mapq", "bin", "flag", "mate_ref", "mate_pos", "tlen")), *((c, s) for c in ("name", "cigar", "seq", "qual")), ("tags", pa.list_(s))])
    return pa.RecordBatch.from_pylist(rows, schema=kinds)


def read_index(data: bytes) -> tuple[list[tuple[dict, list[int]]], int]:
    """([(bins, linear)] per contig, unplaced) of the bytes of a BAI."""
    if data[:4] != b"BAI\1":
        raise ValueError("not a BAI")
    at, out = 8, []
    for _ in range(struct.unpack_from("<I", data, 4)[0]):
        bins, (n,) = {}, struct.unpack_from("<I", data, at)
        at += 4
        for _ in range(n):
            k, c = struct.unpack_from("<II", data, at)
            bins[k] = [struct.unpack_from("<QQ", data, at + 8 + 16 * j) for j in range(c)]
            at += 8 + 16 * c
        (w,) = struct.unpack_from("<I", data, at)
        out.append((bins, list(struct.unpack_from(f"<{w}Q", data, at + 4))))
        at += 4 + 8 * w
    return out, struct.unpack_from("<Q", data, at)[0]
