"""Contigs, their pieces and the seed index that takes the place of a suffix index.

Contigs are cut into pieces of a few thousand bases in one pass, and whatever reads bases reads pieces, so no task and no
join has to move a whole contig.  The index is a Parquet directory: ``contigs`` (one row each), ``pieces``, ``seeds`` (one
row for each k-mer position, range-partitioned and sorted by packed k-mer, so that lookups prune row groups), and a
one-row ``meta`` that names the format and k.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.sequence import normalize
from ..sources.staging import staged, written
from .alignment import CODES

FORMAT = "strandline-index-2"
#: Bases of a piece, and how many of those that follow it are kept beside it.
PIECE, AFTER = 1 << 12, 63
#: Bases of a chunk that a piece is cut into before its windows are listed as text; keeps substring cheap.
CHUNK = 256
#: A k-mer of at most so many bases is packed into a long, two bits a base.
MOST_PACKED = 31
#: Bases that are packed at a time.
BATCH = 1 << 20
#: Contigs of more bases in all are indexed in passes over ranges of k-mers, cut by a sample of pieces of some so many bases.
ONE_PASS, PASSES, SAMPLE = 1 << 23, 8, 1 << 20
#: How seeds are stored: sorted k-mers as differences, not by a dictionary.
STORED = {"parquet.writer.version": "PARQUET_2_0", "parquet.enable.dictionary#kmer": "false", "parquet.enable.dictionary#pos": "false"}


def offsets(lengths: DataFrame, length: str = "length") -> DataFrame:
    """(ref_id, offset) of ``lengths(ref_id, length)``: running sums in the order of ref_id, from sums of blocks."""
    c = lengths.select("ref_id", F.col(length).cast("long").alias("n_"), F.floor(F.col("ref_id") / 1024).alias("block_"))
    before = Window.orderBy("block_").rowsBetween(Window.unboundedPreceding, -1)
    sums = c.groupBy("block_").agg(F.sum("n_").alias("sum_")).select("block_", F.coalesce(F.sum("sum_").over(before), F.lit(0)).alias("base_"))
    inside = Window.partitionBy("block_").orderBy("ref_id").rowsBetween(Window.unboundedPreceding, -1)
    own = c.withColumn("own_", F.coalesce(F.sum("n_").over(inside), F.lit(0)))
    return own.join(sums, "block_").select("ref_id", (F.col("base_") + F.col("own_")).cast("long").alias("offset"))


def contigs(records: DataFrame) -> DataFrame:
    """``records(ref_id, name, seq)`` to contigs with length, running offset and MD5.

    Empty sequences are left out.  The records are written once; offsets come from their lengths alone.
    """
    # The filter comes after the write: before it, Spark would compute a derived sequence for the filter and once more.
    c = staged(records.select("ref_id", "name", F.length("seq").cast("long").alias("length"), F.md5(F.upper("seq")).alias("md5"), normalize("seq").alias("seq"))).where("length > 0")
    return c.join(offsets(c.select("ref_id", "length")), "ref_id").select("ref_id", "name", "length", "offset", "md5", "seq")


def cut(sequences: DataFrame, key: list[str], seq: str = "seq", after: int = AFTER) -> DataFrame:
    """(*key, piece, bases, after): sequences in pieces of PIECE bases with the bases that follow them.

    One pass over a sequence, however long, while substring would walk to each piece from the start.
    """
    s = F.col(seq)
    parts = F.when(F.length(s) <= PIECE, F.array(s)).otherwise(F.regexp_extract_all(s, F.lit("(?s).{1,%d}" % PIECE), F.lit(0)))
    cuts = sequences.select(*key, F.filter(parts, lambda x: x != "").alias("p_"))
    row = lambda x, i: F.struct(i.alias("piece"), x.alias("bases"), F.coalesce(F.substring(F.get("p_", i + 1), 1, after), F.lit("")).alias("after"))
    return cuts.select(*key, F.explode(F.transform("p_", row)).alias("x_")).select(*key, "x_.*")


def kmers(sequences: DataFrame, key: list[str], k: int, seq: str = "seq", chunk: int = CHUNK) -> DataFrame:
    """``(*key, pos, kmer)`` of every window of k bases without N, as text; pos counts from 0."""
    p = cut(sequences, key, seq, max(AFTER, k))
    s = p.select(*key, F.col("piece") * PIECE, F.concat("bases", F.substring("after", 1, k - 1))).toDF(*key, "at_", "s_").where(F.length("s_") >= k)
    chunks = s.select(*key, "at_", "s_", F.explode(F.sequence(F.lit(0), F.length("s_") - k, F.lit(chunk))).alias("o_"))
    chunks = chunks.select(*key, (F.col("at_") + F.col("o_")).alias("at_"), F.substring("s_", F.col("o_") + 1, F.lit(chunk + k - 1)).alias("s_"))
    each = chunks.select(*key, "at_", "s_", F.explode(F.sequence(F.lit(0), F.length("s_") - k)).alias("i_"))
    each = each.select(*key, (F.col("at_") + F.col("i_")).cast("int").alias("pos"), F.substring("s_", F.col("i_") + 1, F.lit(k)).alias("kmer"))
    return each.where(~F.contains("kmer", F.lit("N")))


def pack(codes: np.ndarray, k: int) -> np.ndarray:
    """The windows of k codes as numbers of base four, by doubling their width."""
    n = len(codes) - k + 1
    whole, have, power, width = np.zeros(n, np.int64), 0, codes.astype(np.int64) & 3, 1
    while have < k:
        if k & width:
            whole = whole << (2 * width) | power[have : have + n]
            have += width
        if 2 * width <= k:
            power = power[:-width] << (2 * width) | power[width:]
        width *= 2
    return whole


def packed_kmers(pieces: DataFrame, key: list[str], k: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """``pieces(*key, start, bases)`` to (*key, pos, kmer): every window of k bases without N, packed into a long.

    With ``low`` or ``high``, those from the one on and below the other.
    """
    if not 1 <= k <= MOST_PACKED:
        raise ValueError(f"a seed has 1 to {MOST_PACKED} bases")
    kind = ", ".join(f"{c} {t}" for c, t in pieces.select(*key).dtypes) + ", pos int, kmer long"

    def groups(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Slices of a batch of about BATCH bases."""
        sizes = np.cumsum(pa.compute.binary_length(b.column(len(key) + 1)).fill_null(0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BATCH, side="right")))
            yield b.slice(at, end - at)
            at = end

    def run(batches):
        for whole in batches:
            for b in groups(whole):
                texts = b.column(len(key) + 1).fill_null("")
                ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
                if ends[-1] - ends[0] < k:
                    continue
                codes = CODES[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
                sizes = np.diff(ends)
                row = np.repeat(np.arange(len(sizes)), sizes)
                local = np.arange(len(codes)) - np.repeat(ends[:-1] - ends[0], sizes)
                bad = np.r_[0, np.cumsum(codes > 3)]
                last = len(codes) - k + 1
                ok = np.flatnonzero((local[:last] + k <= sizes[row[:last]]) & (bad[k:] == bad[:last]))
                values = pack(codes, k)[ok] if len(ok) else np.zeros(0, np.int64)
                if low is not None or high is not None:
                    within = (values >= (0 if low is None else low)) & (values < (1 << 62 if high is None else high))
                    ok, values = ok[within], values[within]
                if len(ok):
                    take, start = pa.array(row[ok]), b.column(len(key)).to_numpy(zero_copy_only=False)
                    keys = [c.take(take) for c in b.columns[: len(key)]]
                    pos, kmer = pa.array((start[row[ok]] + local[ok]).astype(np.int32)), pa.array(values)
                    yield pa.RecordBatch.from_arrays([*keys, pos, kmer], [*key, "pos", "kmer"])

    return pieces.select(*key, "start", "bases").mapInArrow(run, kind)


@dataclass
class Reference:
    """Contigs without bases, their pieces, and the saved seeds, if any, with the k they were made for."""

    contigs: DataFrame
    pieces: DataFrame
    seeds: DataFrame | None = None
    k: int = 0

    def kmers(self, k: int, low: int | None = None, high: int | None = None) -> DataFrame:
        """(kmer, ref_id, pos): the saved seeds where k is theirs, else made from the pieces; from ``low`` on and below ``high``."""
        if self.seeds is not None and self.k == k:
            some = self.seeds.select("kmer", "ref_id", "pos")
            some = some if low is None else some.where(F.col("kmer") >= low)
            return some if high is None else some.where(F.col("kmer") < high)
        s = F.concat("bases", F.substring("after", 1, k - 1)).alias("bases")
        # Pieces of one contig may lie in one task; dealt out, they are a twentieth of what is made of them.
        n = int(self.pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = self.pieces.repartition(n, "ref_id", "piece")
        return packed_kmers(dealt.select("ref_id", (F.col("piece") * PIECE).cast("long").alias("start"), s), ["ref_id"], k, low, high).select("kmer", "ref_id", "pos")

    def cuts(self, k: int) -> list[tuple[int | None, int | None]]:
        """Ranges of k-mers, all of them in order, that hold about as many each; a single one if the contigs are short."""
        total = self.contigs.agg(F.sum("length")).first()[0] or 0
        if total <= ONE_PASS:
            return [(None, None)]
        some = Reference(self.contigs, self.pieces.sample(min(1.0, SAMPLE / total), 7)).kmers(k)
        at = sorted({int(x) for x in some.approxQuantile("kmer", [i / PASSES for i in range(1, PASSES)], 0.001)})
        return list(zip([None, *at], [*at, None]))


def reference(refs: DataFrame | Reference, keep: bool = False) -> Reference:
    """Contigs with bases as a Reference; with ``keep`` the pieces are written first, for use in several jobs."""
    if isinstance(refs, Reference):
        return refs
    if keep:
        refs = staged(refs.select("ref_id", "name", F.length("seq").cast("long").alias("length"), "seq"))
        return Reference(refs.drop("seq"), staged(cut(refs, ["ref_id"])))
    return Reference(refs.select("ref_id", "name", F.length("seq").cast("long").alias("length")), cut(refs, ["ref_id"]))


def seed_index(refs: DataFrame | Reference, k: int, low: int | None = None, high: int | None = None) -> DataFrame:
    """(kmer, ref_id, pos, occ): every seed, or those of a range, with its occurrences in its contig, range-partitioned by k-mer."""
    s = reference(refs).kmers(k, low, high).repartitionByRange("kmer")
    # The ranges keep equal k-mers together, so the count needs no other exchange.
    return s.withColumn("occ", F.count("*").over(Window.partitionBy("kmer", "ref_id"))).select("kmer", "ref_id", "pos", "occ")


def save(refs: DataFrame, path: str, k: int) -> None:
    """Write an index.  Seeds are written in passes over ranges of k-mers, so that only those of one are shuffled at a time."""
    spark = refs.sparkSession
    written(refs, f"{path}/contigs", "overwrite")
    known = spark.read.parquet(f"{path}/contigs")
    written(cut(known, ["ref_id"]), f"{path}/pieces", "overwrite")
    of = Reference(known.drop("seq"), spark.read.parquet(f"{path}/pieces"))
    for i, (low, high) in enumerate(of.cuts(k)):
        written(seed_index(of, k, low, high).sortWithinPartitions("kmer", "ref_id"), f"{path}/seeds", "append" if i else "overwrite", **STORED)
    spark.createDataFrame([(FORMAT, k)], "format string, k int").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, int]:
    """(contigs, seeds, k) of a saved index; any other format is refused."""
    meta = spark.read.parquet(f"{path}/meta").first()
    if meta is None or meta["format"] != FORMAT:
        raise ValueError(f"{path} is not an index of format {FORMAT}")
    return spark.read.parquet(f"{path}/contigs"), spark.read.parquet(f"{path}/seeds"), meta["k"]


def opened(spark: SparkSession, path: str) -> Reference:
    """A saved index to map against."""
    refs, seeds, k = load(spark, path)
    return Reference(refs.drop("seq"), spark.read.parquet(f"{path}/pieces"), seeds, k)


def add_contig(refs: DataFrame, more: DataFrame) -> DataFrame:
    """Contigs with more records appended."""
    records = refs.select("ref_id", "name", "seq").unionByName(more.select("ref_id", "name", "seq"))
    return contigs(records)


def locate(positions: DataFrame, refs: DataFrame, position: str = "position") -> DataFrame:
    """Global positions to (ref_id, local).  Contigs are few against positions, but not bounded, so the range join is bucketed."""
    width = 1 << 14
    r = refs.select("ref_id", "offset", "length")
    r = r.withColumn("bucket_", F.explode(F.sequence(F.floor(F.col("offset") / width), F.floor((F.col("offset") + F.col("length") - 1) / width))))
    p = positions.withColumn("bucket_", F.floor(F.col(position) / width))
    hit = (F.col(position) >= F.col("offset")) & (F.col(position) < F.col("offset") + F.col("length"))
    return p.join(r, "bucket_").where(hit).drop("bucket_").withColumn("local", F.col(position) - F.col("offset")).drop("offset", "length")


def windows(rows: DataFrame, refs: DataFrame | Reference) -> DataFrame:
    """``rows(ref_id, window_begin, window_end, ...)`` with ``window``, the bases between; empty windows give no row."""
    at = ["ref_id", "window_begin", "window_end"]
    begin, end = F.col("window_begin"), F.col("window_end")
    n = F.explode(F.sequence(F.floor(begin / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int"))).alias("piece")
    w = rows.where(end > begin).select(*at).distinct().select(*at, n)
    low = F.greatest(begin - F.col("piece") * PIECE, F.lit(0)).cast("int")
    high = F.least(end - F.col("piece") * PIECE, F.lit(PIECE)).cast("int")
    part = F.struct("piece", F.substring("bases", low + 1, high - low).alias("bases"))
    got = w.join(reference(refs).pieces, ["ref_id", "piece"]).groupBy(*at).agg(F.sort_array(F.collect_list(part)).alias("p_"))
    got = got.select(*at, F.array_join(F.transform("p_", lambda p: p["bases"]), "").alias("window"))
    return rows.join(got, at)


def extract(ranges: DataFrame, refs: DataFrame) -> DataFrame:
    """``ranges(start, end)`` in global bases to the bases, cut at the end of the contig that holds ``start``."""
    at = locate(ranges, refs.select("ref_id", "offset", "length"), "start")
    at = at.join(refs.select("ref_id", "length"), "ref_id").withColumn("window_begin", F.col("local"))
    at = at.withColumn("window_end", F.least("length", F.col("local") + F.greatest(F.col("end") - F.col("start"), F.lit(0)))).drop("length")
    key = ["ref_id", "window_begin", "window_end"]
    got = windows(at.select(*key).distinct(), refs)
    return at.join(got, key, "left").withColumn("bases", F.coalesce("window", F.lit(""))).drop("window", "window_begin", "window_end")


def length_of(c: Column) -> Column:
    return F.length(c).cast("long")
