"""Seeds: k-mer joins, maximal exact matches, inexact and rescue seeds, and their filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.sequence import reverse_complement
from ..sources.staging import staged
from .index import Reference, packed_kmers, reference

#: Reads of so many bases in all have at most twice as many k-mers, of some 40 bytes each.
BROADCAST_BASES = 1_000_000
#: So many rows of a long or two are broadcast.
BROADCAST_ROWS = 2_000_000
#: Lengths of the seeds of reads without any match, in the order they are tried.
RESCUE = (5, 4)
#: Such seeds of a read in all contigs.
RESCUED = 4096


def stranded(reads: DataFrame) -> DataFrame:
    """``reads(read_id, seq)``, each once per strand; the reverse in reverse-complement coordinates."""
    sides = F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit("-").alias("strand"), reverse_complement("seq").alias("seq")))
    return reads.select("read_id", F.explode(sides).alias("s")).select("read_id", "s.strand", "s.seq")


def read_kmers(sides: DataFrame, k: int, key: tuple[str, ...] = ("read_id", "strand")) -> DataFrame:
    """(*key, qpos, kmer) of sequences with a column ``seq``, the k-mers packed."""
    whole = sides.select(*key, F.lit(0).cast("long").alias("start"), F.col("seq").alias("bases"))
    return packed_kmers(whole, list(key), k).withColumnRenamed("pos", "qpos")


def seed_hits(reads: DataFrame, refs: DataFrame | Reference, k: int) -> DataFrame:
    """(read_id, strand, ref_id, qpos, rpos) of all k-mers that a read and a contig share.

    Saved seeds are used where the reference has them.  The bases of the reads are summed first: up to
    BROADCAST_BASES their k-mers are broadcast and the reference's are not shuffled; beyond, both sides are.
    """
    q = read_kmers(stranded(reads), k)
    if (reads.agg(F.sum(F.length("seq"))).first()[0] or 0) <= BROADCAST_BASES:
        q = F.broadcast(q)
    return reference(refs).kmers(k).join(q, "kmer").select("read_id", "strand", "ref_id", "qpos", F.col("pos").alias("rpos"))


def indexed_hits(reads: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """As ``seed_hits``, over the seeds of a saved index alone."""
    return seeds.join(read_kmers(stranded(reads), k), "kmer").select("read_id", "strand", "ref_id", "qpos", F.col("pos").alias("rpos"))


def maximal_matches(hits: DataFrame, k: int) -> DataFrame:
    """Runs of hits on one diagonal, which are the maximal exact matches of at least k bases."""
    h = hits.withColumn("diag", F.col("rpos") - F.col("qpos"))
    order = Window.partitionBy("read_id", "strand", "ref_id", "diag").orderBy("qpos")
    h = h.withColumn("island", F.col("qpos") - F.row_number().over(order))
    m = h.groupBy("read_id", "strand", "ref_id", "diag", "island").agg(F.min("qpos").alias("qpos"), F.min("rpos").alias("rpos"), (F.count("*") + (k - 1)).cast("int").alias("len"))
    return m.drop("diag", "island")


def occurrences(mems: DataFrame) -> DataFrame:
    """Matches with ``occ``: how often the same stretch of the read matches in the contig."""
    return mems.withColumn("occ", F.count("*").over(Window.partitionBy("read_id", "strand", "ref_id", "qpos", "len")))


def capped(mems: DataFrame, min_len: int, max_occ: int, most: int = 4) -> DataFrame:
    """At most ``max_occ`` occurrences, and of a match the leftmost few: ``most`` if it is long, else one."""
    m = occurrences(mems).where((F.col("len") >= min_len) & (F.col("occ") <= max_occ))
    order = Window.partitionBy("read_id", "strand", "ref_id", "qpos", "len").orderBy("rpos")
    keep = F.when(F.col("len") >= 2 * min_len, F.lit(most)).otherwise(F.lit(1))
    return m.withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= keep).drop("n_")


def uncontained(mems: DataFrame) -> DataFrame:
    """Matches that do not lie within another of the same read, strand, contig and diagonal.

    Spans that nest on both axes share a diagonal if both are exact and of a run, so this is
    a running maximum over each diagonal and needs no self-join.
    """
    m = mems.withColumn("diag_", F.col("rpos") - F.col("qpos"))
    order = Window.partitionBy("read_id", "strand", "ref_id", "diag_").orderBy("qpos", F.desc("len")).rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("reach_", F.max(F.col("qpos") + F.col("len")).over(order))
    return m.where(F.col("reach_").isNull() | (F.col("qpos") + F.col("len") > F.col("reach_"))).drop("diag_", "reach_")


def coverage(spans: DataFrame, key: list[str], begin: str = "qpos", length: str = "len") -> DataFrame:
    """(*key, covered): positions covered by at least one span."""
    order = Window.partitionBy(*key).orderBy(begin, length).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col(begin) + F.col(length)
    s = spans.withColumn("reach_", F.max(end).over(order))
    gain = F.greatest(F.lit(0), end - F.greatest(F.col(begin), F.coalesce("reach_", F.col(begin))))
    return s.withColumn("gain_", gain).groupBy(*key).agg(F.sum("gain_").cast("long").alias("covered"))


def needs_inexact(mems: DataFrame, reads: DataFrame) -> DataFrame:
    """(read_id, strand) of which less than half is covered by exact matches."""
    cover = coverage(mems, ["read_id", "strand"])
    sides = stranded(reads).select("read_id", "strand", F.length("seq").alias("length"))
    rows = sides.join(cover, ["read_id", "strand"], "left")
    return rows.where(2 * F.coalesce("covered", F.lit(0)) < F.col("length")).select("read_id", "strand")


def strand_vote(mems: DataFrame) -> DataFrame:
    """(read_id, reverse): the strand with the larger sum of match lengths, forward on a tie."""
    side = lambda s: F.sum(F.when(F.col("strand") == s, F.col("len")).otherwise(0)).cast("long")
    v = mems.groupBy("read_id").agg(side("+").alias("forward"), side("-").alias("backward"))
    return v.select("read_id", "forward", "backward", (F.col("backward") > F.col("forward")).alias("reverse"))


def inexact_seeds(reads: DataFrame, refs: DataFrame | Reference, mems: DataFrame, k: int, max_occ: int) -> DataFrame:
    """One-mismatch seeds at read positions that no match covers, for poorly covered strands.

    The forward strand comes first.  For the reverse strand, the positions of all matches and seeds found so far are
    covered, those of the forward strand too, so a read that maps forward is hardly searched again.
    """
    of, place = reference(refs), ["read_id", "strand", "qpos", "len"]
    poor = staged(needs_inexact(mems, reads))
    forward = staged(_one_strand(reads, of, poor.where("strand = '+'"), mems.where("strand = '+'").select(place), k, max_occ))
    both = mems.select(place).unionByName(forward.select(place))
    return forward.unionByName(_one_strand(reads, of, poor.where("strand = '-'"), both, k, max_occ))


def _one_strand(reads: DataFrame, of: Reference, poor: DataFrame, covering: DataFrame, k: int, max_occ: int) -> DataFrame:
    """The one-mismatch seeds of ``poor(read_id, strand)`` at positions outside ``covering(read_id, qpos, len)``.

    For each position the exact k-mer comes first, then its variants in the order of (mismatch
    position, base); the first with a hit gives the seed, at its leftmost position in the contig.
    Variants are numbers; a change of one base is a sum.
    """
    sides = stranded(reads).join(poor, ["read_id", "strand"])
    taken = covering.select("read_id", F.explode(F.sequence("qpos", F.col("qpos") + F.col("len") - 1)).alias("qpos")).distinct()
    q = read_kmers(sides, k).join(taken, ["read_id", "qpos"], "left_anti").select("read_id", "strand", "qpos", "kmer")
    changes = F.array(F.struct(F.lit(-1).alias("mm"), F.lit(-1).alias("base")), *(F.struct(F.lit(i).alias("mm"), F.lit(b).alias("base")) for i in range(k) for b in range(4)))
    v = q.select("*", F.explode(changes).alias("x")).select("read_id", "strand", "qpos", "kmer", "x.*")
    shift = (F.lit(2 * (k - 1)) - 2 * F.col("mm")).cast("int")
    own = F.call_function("shiftright", "kmer", shift).bitwiseAND(F.lit(3))
    changed = F.col("kmer") + F.call_function("shiftleft", (F.col("base") - own).cast("long"), shift)
    v = v.where((F.col("mm") < 0) | (own != F.col("base"))).withColumn("kmer", F.when(F.col("mm") < 0, F.col("kmer")).otherwise(changed))
    q = staged(q)
    few = q.count() * (1 + 3 * k) <= BROADCAST_ROWS
    # Only k-mers that are asked for meet the contigs; their places are then counted.
    hit = of.kmers(k).join(F.broadcast(v) if few else v, "kmer")
    key = ["read_id", "strand", "qpos", "mm", "base", "ref_id"]
    hit = hit.groupBy(*key).agg(F.min("pos").alias("rpos"), F.count("*").alias("occ")).where(F.col("occ") <= max_occ)
    first = F.min(F.struct("mm", "base", "rpos")).alias("x")
    best = hit.groupBy("read_id", "strand", "qpos", "ref_id").agg(first)
    return best.select("read_id", "strand", "ref_id", "qpos", "x.rpos", F.lit(k).alias("len"), (F.col("x.mm") >= 0).alias("inexact"))


def unmatched(reads: DataFrame, mems: DataFrame) -> DataFrame:
    return reads.join(mems.select("read_id").distinct(), "read_id", "left_anti")


def rescue_counts(reads: DataFrame, refs: DataFrame | Reference, mems: DataFrame, max_occ: int, sizes: tuple[int, ...] = RESCUE) -> DataFrame:
    """(read_id, ref_id, k, seeds): positions of reads without any match that have a short seed of each length in a contig.

    Occurrences are counted per contig and k-mer first, so the join never meets positions.
    """
    lone, of, parts = unmatched(reads, mems), reference(refs), []
    for k in sizes:
        q = read_kmers(lone, k, ("read_id",)).groupBy("read_id", "kmer").agg(F.count("*").alias("n"))
        n = _rare(of, k, max_occ).join(q, "kmer").groupBy("read_id", "ref_id").agg(F.sum("n").cast("long").alias("seeds"))
        parts.append(n.select("read_id", "ref_id", F.lit(k).alias("k"), "seeds"))
    return reduce(DataFrame.unionByName, parts)


def _rare(of: Reference, k: int, max_occ: int) -> DataFrame:
    """(ref_id, kmer, pos): the first place of each k-mer in each contig that does not hold it too often."""
    r = of.kmers(k).groupBy("ref_id", "kmer").agg(F.min("pos").alias("pos"), F.count("*").alias("occ"))
    return r.where(F.col("occ") <= 20 * max_occ).drop("occ")


def rescue_seeds(lone: DataFrame, refs: DataFrame | Reference, max_occ: int, sizes: tuple[int, ...] = RESCUE, most: int = RESCUED, step: int = 64) -> DataFrame:
    """Short seeds of the reads in ``lone(read_id, seq)``, forward strand only.

    A position has one seed of each length in a contig, at its first place.  A read has ``most`` seeds at most, in the order of
    contig, length as tried, and position.  So contigs are gone through some at a time, in their order, eight times as many
    in each round, until no read wants more.
    """
    of, low, parts = reference(refs), None, []
    order = Window.partitionBy("read_id").orderBy("ref_id", F.desc("len"), "qpos")
    while True:
        left = of.contigs.select("ref_id") if low is None else of.contigs.select("ref_id").where(F.col("ref_id") > low)
        high = left.orderBy("ref_id").limit(step).agg(F.max("ref_id")).first()[0]
        if high is None:
            break
        span = F.col("ref_id") <= high if low is None else (F.col("ref_id") > low) & (F.col("ref_id") <= high)
        some = Reference(of.contigs.where(span), of.pieces.where(span))
        hits = []
        for k in sizes:
            h = _rare(some, k, max_occ).join(read_kmers(lone, k, ("read_id",)), "kmer")
            hits.append(h.select("read_id", F.lit("+").alias("strand"), "ref_id", "qpos", F.col("pos").alias("rpos"), F.lit(k).alias("len")))
        parts.append(staged(reduce(DataFrame.unionByName, hits)))
        n = reduce(DataFrame.unionByName, parts).groupBy("read_id").agg(F.count("*").alias("n")).where(F.col("n") >= most)
        lone = staged(lone.join(n, "read_id", "left_anti"))
        if lone.isEmpty():
            break
        low, step = high, 8 * step
    if not parts:
        return lone.select("read_id", F.lit("+").alias("strand"), F.lit(0).cast("long").alias("ref_id"), F.lit(0).alias("qpos"), F.lit(0).alias("rpos"), F.lit(0).alias("len")).limit(0)
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("n_", F.row_number().over(order)).where(F.col("n_") <= most).drop("n_")


def best_hit(mems: DataFrame) -> DataFrame:
    """The longest match of each read, ties to (ref_id, strand, rpos, qpos)."""
    order = Window.partitionBy("read_id").orderBy(F.desc("len"), "ref_id", "strand", "rpos", "qpos")
    return mems.withColumn("n_", F.row_number().over(order)).where("n_ = 1").drop("n_")


def chain_edges(mems: DataFrame, max_gap: int) -> DataFrame:
    """Pairs of matches of which the second may follow the first in a chain."""
    key = ["read_id", "strand", "ref_id"]
    a = mems.select(*key, F.col("qpos").alias("q1"), F.col("rpos").alias("r1"), F.col("len").alias("l1"))
    b = mems.select(*key, F.col("qpos").alias("q2"), F.col("rpos").alias("r2"), F.col("len").alias("l2"))
    qgap, rgap = F.col("q2") - F.col("q1") - F.col("l1"), F.col("r2") - F.col("r1") - F.col("l1")
    return a.join(b, key).where(qgap.between(0, max_gap) & rgap.between(0, max_gap)).withColumn("qgap", qgap).withColumn("rgap", rgap)
