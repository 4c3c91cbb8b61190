"""``python -m strandline index ref.fa folder`` and ``python -m strandline mem folder reads.fq [mates.fq] -o out``."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import SparkSession, functions as F

from .config import Config, InsertSize, ReadGroup, preset
from .operators import index, mapping, pairing
from .sources import bam, sam, sequences as io


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    top = argparse.ArgumentParser(prog="strandline", description="map reads with Spark")
    sub = top.add_subparsers(dest="command", required=True)
    i = sub.add_parser("index", help="build an index of a FASTA file")
    i.add_argument("fasta")
    i.add_argument("folder")
    i.add_argument("-k", type=int, default=19)
    m = sub.add_parser("mem", help="map reads", add_help=False)
    m.add_argument("--help", action="help")
    m.add_argument("folder")
    m.add_argument("reads")
    m.add_argument("mates", nargs="?")
    m.add_argument("-o", dest="out", required=True, help="a folder of SAM parts, or a file ending in .bam")
    m.add_argument("-x", dest="preset", action="append", default=[])
    for flag, name in (("k", "seed"), ("c", "occ"), ("w", "band"), ("A", "match"), ("T", "least")):
        m.add_argument(f"-{flag}", dest=name, type=int)
    for flag, name in (("B", "mismatch"), ("O", "gap_open"), ("E", "gap_ext"), ("L", "clip"), ("h", "xa")):
        m.add_argument(f"-{flag}", dest=name, type=lambda v: int(v.split(",")[0]))
    for flag, name in (("a", "all"), ("M", "split_secondary"), ("S", "no_rescue"), ("P", "no_pairing"), ("p", "interleaved"), ("Y", "soft"), ("5", "smallest")):
        m.add_argument(f"-{flag}", dest=name, action="store_true")
    m.add_argument("-t", dest="threads", type=int, help="accepted; Spark sets the parallelism")
    m.add_argument("-I", dest="insert")
    m.add_argument("-R", dest="read_group")
    m.add_argument("-H", dest="header", action="append", default=[])
    return top.parse_args(argv)


def config(a: argparse.Namespace) -> Config:
    """The knobs that the flags ask for; presets first, in their order."""
    cfg = Config()
    for p in a.preset:
        cfg = preset(p, cfg)
    sc = cfg.scoring
    cost = lambda given, now: now if given is None else -abs(given)
    sc = replace(sc, match=sc.match if a.match is None else a.match, mismatch=cost(a.mismatch, sc.mismatch), gap_open=cost(a.gap_open, sc.gap_open), gap_ext=cost(a.gap_ext, sc.gap_ext), clip=cost(a.clip, sc.clip))
    if any(not h.startswith("@") for h in a.header):
        raise ValueError("a header line begins with @")
    given = {"min_seed_len": a.seed, "max_occ": a.occ, "band_width": a.band, "min_output_score": a.least, "xa_max_hits": a.xa}
    cfg = replace(cfg, scoring=sc, **{k: v for k, v in given.items() if v is not None})
    return replace(
        cfg, output_secondary=a.all, mark_split_secondary=a.split_secondary, skip_mate_rescue=a.no_rescue, skip_pairing=a.no_pairing, soft_clip_supplementary=a.soft, smallest_coord_primary=a.smallest,
        insert=InsertSize.parse(a.insert) if a.insert else cfg.insert, read_group=ReadGroup.parse(a.read_group) if a.read_group else None, header_lines=tuple(a.header),
    )


def build(spark: SparkSession, fasta: str, folder: str, k: int = 19) -> None:
    """Index the records of a FASTA file; their order in the file numbers the contigs."""
    r = io.read_records(spark, [fasta]).where("error is null and seq <> '' and qual = ''")
    index.save(index.contigs(r.select(F.col("ord").alias("ref_id"), "name", "seq")), folder, k)


def run(spark: SparkSession, a: argparse.Namespace) -> None:
    if a.command == "index":
        build(spark, a.fasta, a.folder, a.k)
        return
    cfg = config(a)
    of = index.opened(spark, a.folder)
    refs = of.contigs
    scan = lambda path: io.read_records(spark, [path]).where("error is null")
    if a.mates or a.interleaved:
        r = pairing.zipped(scan(a.reads), scan(a.mates)) if a.mates else pairing.interleaved(scan(a.reads))
        rows = pairing.align_pairs(r.select("pair_id", "mate", "name", "seq", "qual"), of, cfg)
    else:
        rows = mapping.align_single(scan(a.reads).select(F.col("ord").alias("read_id"), "name", "seq", "qual"), of, cfg)
    if a.out.endswith(".bam"):
        head = "".join(f"{r['value']}\n" for r in sam.header_rows(refs, cfg, "coordinate").orderBy("section", "n").toLocalIterator())
        bam.write_bam(rows, refs, a.out, head)
    else:
        sam.write_sam(rows, refs, a.out, cfg, gzip=a.out.endswith(".gz"))


if __name__ == "__main__":
    run(SparkSession.builder.appName("strandline").getOrCreate(), arguments())
