"""Single-end mapping: seeds, chains, extension, selection and SAM-ready records.

Everything between the two kernels (chaining and pairwise alignment) is relational.  The kernels see only what
the plan leaves: capped matches, and the few best chains of a read with their windows of the reference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import LONG_READ, Config, preset
from ..functions import sequence as S
from ..sources.staging import staged
from . import seeding
from .alignment import aligner
from .chaining import chains, ranked
from .index import Reference, reference, windows

#: Placements of a read within this distance on one contig are one.
SAME_PLACE = 5


def chain_window(ref_pos: Column, query_begin: Column, query_len: Column, ref_len: Column, band: int) -> tuple[Column, Column]:
    """Where the read would lie under a chain, with half a band of padding, within the contig."""
    pad, at = max(8, band // 2), ref_pos - query_begin
    return F.greatest(F.lit(0), at - pad), F.least(ref_len, at + query_len + pad)


MATCH = ["read_id", "strand", "ref_id", "qpos", "rpos", "len"]


def exact_matches(reads: DataFrame, refs: DataFrame | Reference, k: int, max_occ: int) -> DataFrame:
    """The exact matches that are kept.  Hits are dealt out once, by what all windows over them share."""
    hits = seeding.seed_hits(reads, refs, k).repartition("read_id", "ref_id")
    return seeding.uncontained(seeding.capped(seeding.maximal_matches(hits, k), k, max_occ)).select(MATCH)


def matches(reads: DataFrame, refs: DataFrame | Reference, cfg: Config, rescue: bool = True) -> DataFrame:
    """Exact matches of all reads, inexact seeds where they cover little, and short seeds of reads without any.

    The matches are written, since each step asks for what the steps before it left open.
    """
    k, of = cfg.min_seed_len, reference(refs, keep=True)
    exact = staged(exact_matches(reads, of, k, cfg.max_occ))
    if seeding.needs_inexact(exact, reads).isEmpty():
        return exact
    out = staged(exact.unionByName(seeding.inexact_seeds(reads, of, exact, k, cfg.max_occ).select(MATCH)))
    if rescue and k > max(seeding.RESCUE):
        lone = staged(seeding.unmatched(reads.select("read_id", "seq"), out))
        if not lone.isEmpty():
            out = out.unionByName(seeding.rescue_seeds(lone, of, cfg.max_occ).select(MATCH))
    return out


def needs_extension(cfg: Config) -> Column:
    """Whether a chain of ``ranked`` has to be aligned: the first one, and those whose alignment may be shown.

    These are all of them with secondary output, those on another contig than the first, and those that cover a part of
    the read that the first leaves.  The others count with their chain scores only.
    """
    first = F.col("chain_rank") == 1
    elsewhere = (F.col("ref_id") != F.col("best.ref_id")) & F.lit(cfg.output_supplementary)
    a, n = F.struct(F.col("query_begin").alias("qb"), F.col("query_end").alias("qe")), F.col("query_len")
    p = F.struct(F.col("best.query_begin").alias("qb"), F.col("best.query_end").alias("qe"))
    apart = (_overlap(p, a) <= F.greatest(F.lit(5), F.floor(n / 10))) & (_outside(p, a) >= cfg.min_seed_len)
    return first | F.lit(cfg.output_secondary) | elsewhere | apart


def accepted(cfg: Config) -> Column:
    """Whether the alignment ``sw`` explains its chain, whose score is ``score``."""
    return (F.col("sw.score") >= 10) & (2 * F.col("sw.score") >= F.col("score")) & (F.col("sw.score") >= cfg.min_output_score)


#: Of equal scores the better chain comes first, so its rank precedes the rest.
PLACEMENT = ["read_id", "chain_rank", "ref_id", "strand", "next_score", "query_len", "pos0", "score", "qb", "qe", "ref_span", "cigar", "nm", "md", "skipped_best", "skipped_n"]


def extended(reads: DataFrame, refs: DataFrame | Reference, best: DataFrame, cfg: Config) -> DataFrame:
    """The best chains of each read, extended and accepted: a row per placement.

    A read all of whose extensions are refused is placed by its best chain alone, with that chain's CIGAR and score.
    """
    of = reference(refs, keep=True)
    size = reads.select("read_id", F.length("seq").alias("query_len"), F.col("seq").alias("query"))
    lengths = of.contigs.select("ref_id", F.col("length").alias("ref_len"))
    c = best.join(size.drop("query"), "read_id").withColumn("needed", needs_extension(cfg))
    skipped = Window.partitionBy("read_id")
    c = c.withColumn("skipped_best", F.coalesce(F.max(F.when(~F.col("needed"), F.col("score"))).over(skipped), F.lit(0)))
    c = c.withColumn("skipped_n", F.count_if(~F.col("needed")).over(skipped).cast("int")).where("needed").drop("best", "needed")
    c = staged(c)
    w = c.join(lengths, "ref_id")
    begin, end = chain_window(F.col("mems")[0]["rpos"], F.col("query_begin"), F.col("query_len"), F.col("ref_len"), cfg.band_width)
    w = windows(w.withColumn("window_begin", begin.cast("long")).withColumn("window_end", end.cast("long")), of).join(size.select("read_id", "query"), "read_id")
    w = w.withColumn("query", F.when(F.col("strand") == "-", S.reverse_complement("query")).otherwise(F.col("query")))
    # Few chains are left, but each is dear: they are dealt out evenly.
    w = w.repartition(int(reads.sparkSession.conf.get("spark.sql.shuffle.partitions")), "read_id", "chain_rank")
    w = w.withColumn("sw", aligner(cfg.scoring, cfg.band_width)("query", "window"))
    placed = {
        "pos0": (F.col("window_begin") + F.col("sw.ref_begin")).cast("int"), "score": F.col("sw.score"), "qb": F.col("sw.query_begin"), "qe": F.col("sw.query_end"),
        "ref_span": F.col("sw.ref_end") - F.col("sw.ref_begin"), "cigar": F.col("sw.cigar"), "nm": F.col("sw.nm"), "md": F.col("sw.md"),
    }
    found = staged(w.where(accepted(cfg)).select(*(placed.get(c, F.col(c)).alias(c) for c in PLACEMENT)))
    alone = c.where((F.col("chain_rank") == 1) & (F.col("score") >= cfg.min_output_score)).join(found.select("read_id"), "read_id", "left_anti")
    chain = {
        "pos0": F.col("mems")[0]["rpos"], "qb": F.col("query_begin"), "qe": F.col("query_end"), "ref_span": F.col("ref_end") - F.col("ref_begin"),
        "cigar": S.chain_cigar("mems", F.col("query_len")), "nm": F.lit(None).cast("int"), "md": F.lit(None).cast("string"),
    }
    return found.unionByName(alone.select(*(chain.get(c, F.col(c)).alias(c) for c in PLACEMENT)))


def placements(found: DataFrame) -> DataFrame:
    """(read_id, alns): placements of a read, best score first, those near a better one on the same contig left out."""
    fields = [c for c in PLACEMENT if c != "read_id"]
    row = F.struct((-F.col("score")).alias("order_"), *fields)
    near = lambda kept, a: F.exists(kept, lambda b: (b["ref_id"] == a["ref_id"]) & (F.abs(b["pos0"] - a["pos0"]) <= SAME_PLACE))
    per = found.groupBy("read_id").agg(F.sort_array(F.collect_list(row)).alias("all_"))
    none = F.filter("all_", lambda a: F.lit(False))
    return per.select("read_id", F.aggregate("all_", none, lambda kept, a: F.when(near(kept, a), kept).otherwise(F.array_append(kept, a))).alias("alns"))


def _overlap(p: Column, a: Column) -> Column:
    return F.greatest(F.lit(0), F.least(p["qe"], a["qe"]) - F.greatest(p["qb"], a["qb"]))


def _outside(p: Column, a: Column) -> Column:
    return F.greatest(F.lit(0), p["qb"] - a["qb"]) + F.greatest(F.lit(0), a["qe"] - p["qe"])


def is_split(p: Column, a: Column, cfg: Config) -> Column:
    """Whether ``a`` aligns the part of the read that the primary ``p`` leaves."""
    both, n = _overlap(p, a), p["query_len"]
    combined = p["qe"] - p["qb"] + a["qe"] - a["qb"] - both
    enough = (a["qe"] - a["qb"] >= cfg.min_seed_len) & (a["score"] >= cfg.min_chain_score)
    return (both <= F.greatest(F.lit(5), F.floor(n / 10))) & (_outside(p, a) >= cfg.min_seed_len) & (combined * 10 >= n * 7) & enough


def rivals() -> tuple[Column, Column, Column]:
    """What the placement ``a`` competes with: the best other score, the second chain's score, and how many others there are.

    Chains that were not extended compete with their scores.
    """
    return F.greatest("second", "a.skipped_best"), F.coalesce("a.next_score", F.lit(0)), F.col("n") - 1 + F.col("a.skipped_n")


def hard_clipped(cigar: Column) -> Column:
    return F.translate(cigar, "S", "H")


def records(reads: DataFrame, refs: DataFrame | Reference, placed: DataFrame, cfg: Config) -> DataFrame:
    """A row per record: the primary of every read, and its secondary and supplementary records.

    kind_ord orders them as they are written: primary, secondary, supplementary.
    """
    p = placed.withColumn("p", F.col("alns")[0])
    splits = F.transform("alns", lambda a, i: (i > 0) & (i < 4) & is_split(F.col("p"), a, cfg))
    p = p.withColumn("split_at", F.array_position(splits, True).cast("int") - 1)
    if cfg.smallest_coord_primary:  # the split segment with the smaller coordinate comes first
        s = F.get(F.col("alns"), F.greatest("split_at", F.lit(0)))
        earlier = (F.col("split_at") > 0) & (F.struct(s["ref_id"], s["pos0"]) < F.struct(F.col("p.ref_id"), F.col("p.pos0")))
        p = p.withColumn("first_", F.when(earlier, F.col("split_at")).otherwise(F.lit(0)))
    else:
        p = p.withColumn("first_", F.lit(0))
    p = p.withColumn("split_at", F.when(F.col("first_") > 0, F.lit(0)).otherwise(F.col("split_at")))
    p = p.withColumn("second", F.coalesce(F.get("alns", F.lit(1))["score"], F.lit(0))).withColumn("n", F.size("alns"))
    rows = p.select("read_id", "first_", "split_at", "second", "n", "p", F.posexplode("alns").alias("i", "a"))
    supp = (F.col("i") == F.col("split_at")) | ((F.col("a.ref_id") != F.col("p.ref_id")) & (F.col("a.score") >= cfg.min_chain_score))
    kind = F.when(F.col("i") == F.col("first_"), "primary").when(supp & F.lit(cfg.output_supplementary), "supplementary").otherwise("secondary")
    rows = rows.withColumn("kind", kind)
    quality = S.mapq("a.score", *rivals(), F.col("a.qe") - F.col("a.qb"), "a.ref_span", cfg.scoring.match, -cfg.scoring.mismatch, cfg.min_seed_len)
    rows = rows.withColumn("mapq", F.when(F.col("kind") == "primary", quality).otherwise(F.lit(0)))
    names = reference(refs).contigs.select("ref_id", F.col("name").alias("rname"))
    rows = rows.withColumn("ref_id", F.col("a.ref_id")).join(names, "ref_id")
    rows = rows.withColumn("reverse", F.col("a.strand") == "-")
    rows = rows.withColumn("hard", (F.col("i") == F.col("split_at")) & (F.col("kind") == "supplementary") & F.lit(not cfg.soft_clip_supplementary))
    rows = rows.withColumn("shown_cigar", F.when(F.col("hard"), hard_clipped(F.col("a.cigar"))).otherwise(F.col("a.cigar")))
    rows = rows.withColumn("pos", F.col("a.pos0") + 1)
    rows = tagged(rows, cfg)
    full = reads.select("read_id", "name", F.col("seq").alias("s_"), F.col("qual").alias("q_"))
    out = full.join(rows, "read_id", "left").withColumn("kind", F.coalesce("kind", F.lit("primary")))
    mapped = F.col("ref_id").isNotNull()
    turned = F.when(F.col("reverse"), S.reverse_complement("s_")).otherwise(F.col("s_"))
    quals = F.when(F.col("reverse"), F.reverse("q_")).otherwise(F.col("q_"))
    part = lambda c: F.when(F.col("hard"), F.substring(c, F.col("a.qb") + 1, F.col("a.qe") - F.col("a.qb"))).otherwise(c)
    flag = S.flag(unmapped=~mapped, reverse="reverse", secondary=F.col("kind") == "secondary", supplementary=F.col("kind") == "supplementary")
    order = F.when(F.col("kind") == "primary", 0).when(F.col("kind") == "secondary", 1).otherwise(2)
    out = out.select(
        "read_id", "name", "kind", order.alias("kind_ord"), F.coalesce("i", F.lit(0)).alias("idx"), flag.alias("flag"), "ref_id", F.coalesce("rname", F.lit("*")).alias("rname"), F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("mapq", F.lit(0)).alias("mapq"),
        F.coalesce("shown_cigar", F.lit("*")).alias("cigar"), F.lit("*").alias("rnext"), F.lit(0).alias("pnext"), F.lit(0).alias("tlen"), part(turned).alias("seq"), F.coalesce(part(quals), F.lit("*")).alias("qual"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("a.score", F.lit(0)).alias("score"), F.coalesce("a.ref_span", F.lit(0)).alias("ref_span"),
    )
    out = out.withColumn("qual", F.when(F.col("qual") == "", "*").otherwise(F.col("qual")))
    if not cfg.output_secondary:
        out = out.where("kind <> 'secondary'")
    if cfg.mark_split_secondary:
        out = out.withColumn("flag", S.split_as_secondary("flag"))
    return out


def tagged(rows: DataFrame, cfg: Config) -> DataFrame:
    """Tags in the order NM, AS, MD, SA, XA, XS.  A read has four placements at most, so they fit a window."""
    all_of = Window.partitionBy("read_id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    entry = F.struct("i", "kind", F.col("a.score").alias("score"), S.sa_entry("rname", "pos", "reverse", "a.cigar", "mapq", "a.nm").alias("sa"), F.concat(F.col("rname"), F.lit(","), F.when(F.col("reverse"), "-").otherwise("+"), F.col("pos").cast("string"), F.lit(","), F.col("a.cigar"), F.lit(","), F.col("a.nm").cast("string"), F.lit(";")).alias("xa"))
    rows = rows.withColumn("others_", F.collect_list(entry).over(all_of))
    sa = F.array_join(F.transform(F.filter("others_", lambda o: (o["i"] != F.col("i")) & (o["kind"] != "secondary")), lambda o: o["sa"]), "")
    best = F.array_max(F.transform("others_", lambda o: o["score"]))
    hits = F.filter("others_", lambda o: (o["kind"] == "secondary") & (o["score"] > F.floor((4 * best + 2) / 5)))
    xa = F.when(F.lit(cfg.output_xa) & F.size(hits).between(1, cfg.xa_max_hits - 1), F.array_join(F.transform(hits, lambda o: o["xa"]), "")).otherwise(F.lit(""))
    primary = F.col("kind") == "primary"
    tag = lambda name, value, when: F.when(when, F.concat(F.lit(name), value.cast("string")))
    tags = F.array_compact(F.array(
        tag("NM:i:", F.col("a.nm"), F.lit(True)), tag("AS:i:", F.col("a.score"), F.lit(True)), tag("MD:Z:", F.col("a.md"), F.lit(True)),
        tag("SA:Z:", sa, (F.col("kind") != "secondary") & (sa != "")), tag("XA:Z:", xa, primary & (xa != "")), tag("XS:i:", F.col("a.next_score"), primary & (F.col("a.next_score") > 0)),
    ))
    return rows.withColumn("tags", tags).drop("others_")


def align_single(reads: DataFrame, refs: DataFrame | Reference, cfg: Config = Config(), rescue: bool = True) -> DataFrame:
    """``reads(read_id, name, seq, qual)`` against contigs or a saved index; long reads take the long-read knobs."""
    parts, of = [], reference(refs, keep=True)
    reads = staged(reads.select("read_id", "name", "seq", "qual"))
    for c, some in ((cfg, reads.where(F.length("seq") <= LONG_READ)), (preset("long_reads", cfg), reads.where(F.length("seq") > LONG_READ))):
        if some.isEmpty():
            continue
        clean = some.withColumn("seq", S.normalize("seq"))
        best = ranked(chains(matches(clean, of, c, rescue), c.max_gap, c.min_chain_score), c.max_alignments)
        parts.append(records(some, of, placements(extended(clean, of, best, c)), c))
    if not parts:
        return records(reads, of, placements(reads.sparkSession.createDataFrame([], _EMPTY)), cfg)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


_EMPTY = "read_id long, chain_rank int, ref_id long, strand string, next_score int, query_len int, pos0 int, score int, qb int, qe int, ref_span int, cigar string, nm int, md string, skipped_best int, skipped_n int"
