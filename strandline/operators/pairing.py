"""Mates: pairing by ordinal, proper pairs, insert sizes, rescue and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import Config, InsertSize
from ..functions import sequence as S
from ..sources.staging import staged
from . import mapping
from .alignment import aligner
from .index import Reference, reference, windows

SAMPLE, LEAST, QUALITY = 512, 20, 20
#: Bases on either side of a mate that are searched while the insert size is unknown.
WINDOW = 2000


def interleaved(reads: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Records 2i and 2i + 1 are mates 1 and 2 of pair i."""
    return reads.withColumn("pair_id", F.floor(F.col(ordinal) / 2)).withColumn("mate", (F.col(ordinal) % 2 + 1).cast("int"))


def zipped(first: DataFrame, second: DataFrame, ordinal: str = "ord") -> DataFrame:
    """Mates of two files by ordinal; what the longer file has more is left out."""
    both = first.select(ordinal).join(second.select(ordinal), ordinal, "left_semi")
    one = first.join(both, ordinal, "left_semi").withColumn("mate", F.lit(1))
    two = second.join(both, ordinal, "left_semi").withColumn("mate", F.lit(2))
    return one.unionByName(two).withColumn("pair_id", F.col(ordinal))


def forward_reverse(pos1: Column, rev1: Column, pos2: Column, rev2: Column) -> Column:
    """Whether the left mate is forward and the right one reverse."""
    return (rev1 != rev2) & F.when(rev1, pos2 <= pos1).otherwise(pos1 <= pos2)


def reach(mean: Column, std: Column, most: Column, valid: Column, otherwise: float) -> Column:
    """How far mates may lie apart: four deviations above the mean, at least 200 and at most ``most`` where that is set."""
    far = mean + 4 * std
    return F.when(valid, F.greatest(F.lit(200.0), F.when(most > 0, F.least(far, most)).otherwise(far))).otherwise(F.lit(float(otherwise)))


def _known(stats: InsertSize) -> tuple[Column, Column, Column, Column]:
    return F.lit(float(stats.mean)), F.lit(float(stats.std)), F.lit(float(stats.max_window)), F.lit(stats.valid)


def trimmed_moments(values: DataFrame, value: str, order: str, first: int = SAMPLE, least: int = LEAST) -> DataFrame:
    """(n, mean, std) of the first values in order, a tenth cut off at each end; no row if there are too few."""
    v = values.where(F.col(order) < first).select(F.col(value).alias("v_"), F.col(order).alias("o_"))
    whole = Window.partitionBy(F.lit(0))  # at most ``first`` rows
    v = v.withColumn("rank_", F.row_number().over(whole.orderBy("v_", "o_"))).withColumn("n_", F.count("*").over(whole))
    cut = F.floor(F.col("n_") / 10)
    v = v.where((F.col("n_") >= least) & (F.col("rank_") > cut) & (F.col("rank_") <= F.col("n_") - cut))
    return v.groupBy("n_").agg(F.avg("v_").alias("mean"), F.stddev_pop("v_").alias("std")).withColumnRenamed("n_", "n")


def joined(primaries: DataFrame) -> DataFrame:
    """(pair_id, a, b): the primaries of both mates side by side."""
    row = F.struct(*primaries.columns)
    side = lambda m: F.max(F.when(F.col("mate") == m, row))
    return primaries.groupBy("pair_id").agg(side(1).alias("a"), side(2).alias("b")).where("a is not null and b is not null")


def five_ends(p: DataFrame) -> DataFrame:
    """Pairs with strands, 5' ends and the distance between them."""
    for m in "ab":
        p = p.withColumn(f"rev_{m}", S.has_flag(f"{m}.flag", "reverse")).withColumn(f"map_{m}", ~S.has_flag(f"{m}.flag", "unmapped"))
        p = p.withColumn(f"five_{m}", S.five_prime(f"{m}.pos", f"rev_{m}", f"{m}.ref_span"))
    same = F.col("map_a") & F.col("map_b") & F.coalesce(F.col("a.ref_id") == F.col("b.ref_id"), F.lit(False))
    p = p.withColumn("insert", F.abs(F.col("five_a") - F.col("five_b")) + 1)
    return p.withColumn("facing", same & forward_reverse(F.col("a.pos"), F.col("rev_a"), F.col("b.pos"), F.col("rev_b")))


def insert_size(pairs: DataFrame) -> InsertSize:
    """Statistics of the confident pairs among the first ones."""
    clean = pairs.where(F.col("facing") & (F.col("a.mapq") >= QUALITY) & (F.col("b.mapq") >= QUALITY))
    row = trimmed_moments(clean, "insert", "pair_id").first()
    if row is None:
        return InsertSize()
    return InsertSize(row["mean"], row["std"], row["mean"] + 4 * row["std"], True)


def rescued(reads: DataFrame, refs: DataFrame | Reference, primaries: DataFrame, stats: InsertSize, cfg: Config) -> DataFrame:
    """New primaries for unmapped mates of mapped ends, aligned near their mates on both strands."""
    p = joined(primaries)
    free = lambda m: S.has_flag(f"{m}.flag", "unmapped")
    lone = p.where(free("a") != free("b"))
    lost, anchor = F.when(free("a"), F.col("a")).otherwise(F.col("b")), F.when(free("a"), F.col("b")).otherwise(F.col("a"))
    lone = lone.select("pair_id", lost.alias("lost"), anchor.alias("anchor"))
    w = reach(*_known(stats), WINDOW).cast("int")
    of = reference(refs)
    lengths = of.contigs.select("ref_id", F.col("length").alias("ref_len"))
    lone = lone.withColumn("ref_id", F.col("anchor.ref_id")).join(lengths, "ref_id")
    at = F.col("anchor.pos") - 1
    lone = lone.withColumn("window_begin", F.greatest(F.lit(0), at - w)).withColumn("window_end", F.least("ref_len", at + F.col("anchor.ref_span") + w))
    lone = windows(lone.withColumn("window_begin", F.col("window_begin").cast("long")).withColumn("window_end", F.col("window_end").cast("long")), of)
    seq = reads.select("pair_id", "mate", S.normalize("seq").alias("query"))
    lone = lone.withColumn("mate", F.col("lost.mate")).join(seq, ["pair_id", "mate"])
    both = lone.withColumn("strand", F.explode(F.array(F.lit("+"), F.lit("-"))))
    both = both.withColumn("query", F.when(F.col("strand") == "-", S.reverse_complement("query")).otherwise(F.col("query")))
    both = both.withColumn("sw", aligner(cfg.scoring, 0)("query", "window")).where(F.col("sw.score") >= cfg.min_chain_score)
    order = Window.partitionBy("pair_id").orderBy(F.desc("sw.score"), "strand")
    both = both.withColumn("n_", F.row_number().over(order)).where("n_ = 1")
    reverse = F.col("strand") == "-"
    tags = F.array(F.concat(F.lit("NM:i:"), F.col("sw.nm").cast("string")), F.concat(F.lit("AS:i:"), F.col("sw.score").cast("string")), F.concat(F.lit("MD:Z:"), F.col("sw.md")))
    new = {
        "flag": F.when(reverse, 16).otherwise(0), "ref_id": F.col("ref_id"), "rname": F.col("anchor.rname"), "pos": (F.col("window_begin") + F.col("sw.ref_begin") + 1).cast("int"), "mapq": F.lit(-1), "cigar": F.col("sw.cigar"),
        "seq": F.when(reverse, S.reverse_complement("lost.seq")).otherwise(F.col("lost.seq")), "qual": F.when(reverse, F.reverse("lost.qual")).otherwise(F.col("lost.qual")), "tags": tags, "score": F.col("sw.score"), "ref_span": F.col("sw.ref_end") - F.col("sw.ref_begin"),
    }
    return both.select(*(new[c].alias(c) if c in new else F.col(f"lost.{c}").alias(c) for c in primaries.columns))


def marked(rows: DataFrame, limit: Column, cfg: Config) -> DataFrame:
    """Records of pairs with flags, mate fields, template lengths and the quality of rescued ends."""
    prim = rows.where("kind = 'primary'")
    p = five_ends(joined(prim))
    p = p.withColumn("proper", F.col("facing") & (F.col("insert") <= limit) & F.lit(not cfg.skip_pairing))
    one = S.template_length("five_a", "five_b")
    sides = []
    for m, o, t in (("a", "b", one), ("b", "a", -one)):
        quality = F.when(F.col(f"{m}.mapq") < 0, F.when(F.col("proper"), F.least(F.lit(20), F.col(f"{o}.mapq"))).otherwise(F.lit(0))).otherwise(F.col(f"{m}.mapq"))
        sides.append(p.select("pair_id", F.lit(1 if m == "a" else 2).alias("mate"), "proper", quality.alias("q_"), F.col(f"map_{o}").alias("m_"), (F.col(f"rev_{o}") & F.col(f"map_{o}")).alias("r_"), F.col(f"{o}.rname").alias("n_"), F.col(f"{o}.pos").alias("p_"), F.when(F.col("proper"), t).otherwise(F.lit(0)).alias("t_")))
    info = sides[0].unionByName(sides[1])
    out = rows.join(info, ["pair_id", "mate"])
    main = F.col("kind") == "primary"
    more = S.flag(paired=F.lit(True), proper="proper", mate_unmapped=~F.col("m_"), mate_reverse="r_", first=F.col("mate") == 1, second=F.col("mate") == 2)
    rnext = F.when(~F.col("m_"), "*").when(F.col("n_") == F.col("rname"), "=").otherwise(F.col("n_"))
    out = out.withColumn("flag", F.col("flag").bitwiseOR(more)).withColumn("mapq", F.when(main, F.col("q_")).otherwise(F.col("mapq")))
    out = out.withColumn("rnext", rnext).withColumn("pnext", F.when(F.col("m_"), F.col("p_")).otherwise(F.lit(0))).withColumn("tlen", F.when(main, F.col("t_")).otherwise(F.lit(0)))
    return out.drop("proper", "q_", "m_", "r_", "n_", "p_", "t_")


def align_pairs(reads: DataFrame, refs: DataFrame | Reference, cfg: Config = Config()) -> DataFrame:
    """``reads(pair_id, mate, name, seq, qual)`` against contigs; records as of ``align_single`` with mate fields.

    The alignments are written to the shared folder once, as the insert sizes are a job of their own.
    """
    refs = reference(refs, keep=True)
    each = reads.withColumn("read_id", (F.col("pair_id") * 2 + F.col("mate") - 1).cast("long"))
    rows = mapping.align_single(each.select("read_id", "name", "seq", "qual"), refs, cfg)
    rows = staged(rows.withColumn("pair_id", F.floor(F.col("read_id") / 2)).withColumn("mate", (F.col("read_id") % 2 + 1).cast("int")))
    prim = rows.where("kind = 'primary'")
    stats = cfg.insert if cfg.insert.valid else insert_size(five_ends(joined(prim)))
    if not cfg.skip_mate_rescue:
        new = staged(rescued(each, refs, prim, stats, cfg))
        old = rows.join(new.select("read_id", "kind"), ["read_id", "kind"], "left_anti").select(rows.columns)
        rows = old.unionByName(new.select(rows.columns))
    return marked(rows, reach(*_known(stats), cfg.max_gap), cfg)
