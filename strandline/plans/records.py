"""Queries over the selection of records, with their SQL.

Orders are reads and their lines are chains and alignments, so that the operators of mapping and pairing run over whole
tables: the gate before extension, acceptance, placements, records with their kinds, flags, clips, qualities and tags.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window, functions as F

from ..config import LONG_READ, Config, InsertSize, preset
from ..functions import sequence as S
from ..operators import chaining, mapping, pairing
from ..operators.index import Reference
from ..sources import bam, sequences as io
from .sequences import DNA, read, reads

CFG = Config(output_secondary=True, min_output_score=15)
LENGTH = 130


def lines(spark, sf_dir) -> DataFrame:
    """Lines of an order as chains of a read: chain_no in line order, score, spans, contig, strand."""
    li = read(spark, sf_dir, "lineitem")
    n, qb = F.col("l_quantity").cast("int"), (F.col("l_partkey") % 80).cast("int")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    begin = (F.col("l_partkey") % 2000).cast("int")
    return li.select(
        F.col("l_orderkey").alias("read_id"), F.when(F.col("l_partkey") % 2 == 1, "-").otherwise("+").alias("strand"), (F.col("l_suppkey") % 4).alias("ref_id"), F.row_number().over(order).alias("chain_no"),
        n.alias("score"), qb.alias("query_begin"), (qb + n).alias("query_end"), begin.alias("ref_begin"), (begin + n).alias("ref_end"), F.lit(LENGTH).alias("query_len"),
    )


def alignments(spark, sf_dir) -> DataFrame:
    """The lines as accepted placements."""
    c = lines(spark, sf_dir)
    clip = lambda v: F.when(v > 0, F.concat(v.cast("string"), F.lit("S"))).otherwise(F.lit(""))
    cigar = F.concat(clip(F.col("query_begin")), F.col("score").cast("string"), F.lit("="), clip(F.col("query_len") - F.col("query_end")))
    c = c.select("*", F.struct("score").alias("sw"), cigar.alias("cigar")).withColumn("n_", F.col("score")).withColumn("score", F.col("query_begin") + 5)
    c = c.where(mapping.accepted(CFG)).withColumn("score", F.col("n_"))
    made = {
        "chain_rank": F.col("chain_no"), "next_score": (F.col("read_id") % 40).cast("int"), "pos0": F.col("ref_begin"), "qb": F.col("query_begin"), "qe": F.col("query_end"), "ref_span": F.col("score"),
        "nm": F.col("score") % 5, "md": F.col("score").cast("string"), "skipped_best": (F.col("read_id") % 7).cast("int"), "skipped_n": (F.col("read_id") % 3).cast("int"),
    }
    return c.select(*(made.get(x, F.col(x)).alias(x) for x in mapping.PLACEMENT))


def records(spark, sf_dir, cfg: Config = CFG) -> DataFrame:
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("read_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), F.repeat(F.lit("ACGTTGCAAC"), 13).alias("seq"), F.repeat(F.lit("ABCDEFGHIJ"), 13).alias("qual"))
    refs = spark.range(4).select(F.col("id").alias("ref_id"), F.concat(F.lit("chr"), F.col("id").cast("string")).alias("name"), F.lit(4000).alias("length"))
    return mapping.records(o, Reference(refs, refs), mapping.placements(alignments(spark, sf_dir)), cfg)


def accepted_extensions(spark, sf_dir):
    return alignments(spark, sf_dir).select("read_id", "chain_rank", "score", "cigar")


def near_placements(spark, sf_dir):
    """Placements of a read with no better one within five positions on the contig, best first."""
    p = mapping.placements(alignments(spark, sf_dir)).select("read_id", F.posexplode("alns").alias("i", "a"))
    return p.select("read_id", "i", "a.chain_rank", "a.ref_id", "a.pos0", "a.score")


def chain_ranks(spark, sf_dir):
    """Chains of a read best first, with the second one's score."""
    return chaining.ranked(lines(spark, sf_dir)).select("read_id", "chain_no", "chain_rank", "next_score", F.col("best.ref_id").alias("best_ref"), F.col("best.query_begin").alias("best_begin"))


def extension_gate(spark, sf_dir):
    """Which chains need an alignment of their own when secondary records are not asked for."""
    c = chaining.ranked(lines(spark, sf_dir))
    return c.select("read_id", "chain_rank", mapping.needs_extension(Config()).alias("extend"))


def read_scores(spark, sf_dir):
    """What the mapping quality of a read's first placement competes with."""
    p = mapping.placements(alignments(spark, sf_dir)).withColumn("a", F.col("alns")[0]).withColumn("n", F.size("alns")).withColumn("second", F.coalesce(F.get("alns", F.lit(1))["score"], F.lit(0)))
    sub, csub, sub_n = mapping.rivals()
    return p.select("read_id", F.col("a.score").alias("best"), sub.alias("sub"), csub.alias("csub"), sub_n.alias("sub_n"))


def record_table(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("read_id", "kind", "idx", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual", F.array_join("tags", ";").alias("tags"), "score", "ref_span")


def tag(name: str):
    """The value of a tag, null where a record has none."""
    return F.get(F.filter("tags", lambda t: F.startswith(t, F.lit(f"{name}:Z:"))), F.lit(0))


def sa_tags(spark, sf_dir):
    """SA of each record: the other primary and supplementary records of its read."""
    return records(spark, sf_dir).where("rname <> '*'").select("read_id", "idx", tag("SA").alias("sa"))


def xa_tags(spark, sf_dir):
    """XA of primary records: secondary ones near the best score, if there are few."""
    return records(spark, sf_dir).where("kind = 'primary'").select("read_id", tag("XA").alias("xa"))


def cross_contig(spark, sf_dir):
    """Supplementary records, as splits of the read or on other contigs than the primary."""
    return records(spark, sf_dir).where("kind = 'supplementary'").select("read_id", "idx", "rname", "pos")


def supplementary_rows(spark, sf_dir):
    """Supplementary records: flag, quality zero, hard clips and cut sequences where they are splits."""
    r = records(spark, sf_dir).where("kind = 'supplementary'")
    return r.select("read_id", "idx", "flag", "mapq", "cigar", "seq", F.element_at("tags", 1).alias("nm"))


def clip_rewrite(spark, sf_dir):
    """Supplementary records with soft clips kept."""
    r = records(spark, sf_dir, replace(CFG, soft_clip_supplementary=True)).where("kind = 'supplementary'")
    return r.select("read_id", "idx", "cigar", "seq")


def smallest_coordinate(spark, sf_dir):
    """Primary and supplementary records when a split with the smaller coordinate comes first."""
    r = records(spark, sf_dir, replace(CFG, smallest_coord_primary=True))
    return r.where("kind <> 'secondary'").select("read_id", "kind", "idx", "flag", "rname", "pos", "mapq")


def unmapped_rows(spark, sf_dir):
    """Reads without any placement."""
    r = records(spark, sf_dir).where(S.has_flag("flag", "unmapped"))
    return r.select("read_id", "kind", "flag", "rname", "pos", "mapq", "cigar", "seq", F.size("tags").alias("n_tags"))


def rescue_limits(spark, sf_dir):
    """Largest proper insert and rescue window from a mean and a deviation per order."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 500).cast("double").alias("mean"), (F.col("o_orderkey") % 90).cast("double").alias("std"))
    valid, most = F.col("mean") >= 100, F.when(F.col("o_orderkey") % 2 == 0, 700.0).otherwise(0.0)
    limit = pairing.reach(F.col("mean"), F.col("std"), most, valid, float(Config().max_gap))
    window = pairing.reach(F.col("mean"), F.col("std"), most, valid, pairing.WINDOW)
    return o.select("o_orderkey", limit.cast("long").alias("max_insert"), window.cast("long").alias("window"))


def length_config(spark, sf_dir):
    """The knobs that a read's length selects."""
    short, long = Config(), preset("long_reads", Config())
    pick = lambda f: F.when(F.length("seq") > LONG_READ, F.lit(f(long))).otherwise(F.lit(f(short)))
    return reads(spark, sf_dir).select("read_id", pick(lambda c: c.min_seed_len).alias("min_seed_len"), pick(lambda c: c.max_occ).alias("max_occ"), pick(lambda c: c.max_gap).alias("max_gap"), pick(lambda c: c.band_width).alias("band"), pick(lambda c: c.min_chain_score).alias("min_chain_score"), pick(lambda c: c.scoring.mismatch).alias("mismatch"))


def written(spark, sf_dir) -> DataFrame:
    """Lines as the places that a BAM's writer reports: parts by supplier, records in key order, ends of parts."""
    li = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("part").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    ref, pos = F.when(F.col("l_returnflag") == "N", (F.col("l_partkey") % 50).cast("int")).otherwise(F.lit(-1)), (F.col("l_orderkey") % 3000 * 37).cast("int")
    r = li.select((F.col("l_suppkey") % 8).cast("int").alias("part"), ref.alias("ref_idx"), pos.alias("pos0"), (pos + 1 + F.col("l_quantity").cast("int") * 400).alias("end0"), "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    n = F.row_number().over(order)
    r = r.select("part", n.cast("long").alias("n"), "ref_idx", "pos0", "end0", S.reg2bin("pos0", "end0").alias("bin"), F.floor(n / 100).alias("block"), (n % 100 * 500).cast("int").alias("inside"), F.lit(None).cast("string").alias("file"))
    end = r.groupBy("part").agg(F.max("n").alias("m")).select("part", (F.col("m") + 1).alias("n"), F.lit(-1).alias("ref_idx"), F.lit(-1).alias("pos0"), F.lit(0).alias("end0"), F.lit(0).alias("bin"), (F.floor(F.col("m") / 100) + 1).alias("block"), F.lit(0).alias("inside"), F.lit("part").alias("file"))
    return r.unionByName(end)


def chunk_ends(spark, sf_dir):
    """Virtual offsets of records and of those that follow them, from the sizes of parts."""
    v = bam.virtual_offsets(written(spark, sf_dir), 77)
    return v.select("part", "n", "ref_idx", "beg", "end")


def backfill(spark, sf_dir):
    """The linear index over the written parts, windows without records taking the next one's offset."""
    return bam.index_linear(bam.virtual_offsets(written(spark, sf_dir), 77))


def accuracy_counts(spark, sf_dir):
    """Primary records against true places, by the operator that scores simulated reads."""
    r = records(spark, sf_dir).withColumn("line_no", F.col("idx"))
    t = read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("name"), (F.col("o_custkey") % 2000).cast("int").alias("pos"), (F.col("o_orderkey") % 2 == 1).alias("reverse"))
    a = io.accuracy(r, t)
    return a.withColumn("avg_mapq", F.round("avg_mapq", 6))


def last_record(spark, sf_dir):
    """Records of a name that is repeated: the last one in the file is scored."""
    r = records(spark, sf_dir).select(F.concat(F.lit("o"), (F.col("read_id") % 100).cast("string")).alias("name"), F.col("read_id").alias("line_no"), "flag", "pos", "mapq", "cigar")
    t = spark.range(100).select(F.concat(F.lit("o"), F.col("id").cast("string")).alias("name"), (F.col("id") * 20).cast("int").alias("pos"), (F.col("id") % 2 == 1).alias("reverse"))
    a = io.accuracy(r, t, near=300)
    return a.withColumn("avg_mapq", F.round("avg_mapq", 6))


QUERIES = {
    f.__name__: f
    for f in (
        accepted_extensions, near_placements, chain_ranks, extension_gate, read_scores, record_table, sa_tags, xa_tags, cross_contig, supplementary_rows, clip_rewrite, smallest_coordinate, unmapped_rows, rescue_limits, length_config,
        chunk_ends, backfill, accuracy_counts, last_record,
    )
}

ALIGNED = f"""z AS (
  SELECT l_orderkey AS read_id, CASE WHEN l_partkey % 2 = 1 THEN '-' ELSE '+' END AS strand, l_suppkey % 4 AS ref_id, CAST(l_partkey % 2000 AS INTEGER) AS pos0, CAST(l_partkey % 80 AS INTEGER) AS qb, CAST(l_partkey % 80 + l_quantity AS INTEGER) AS qe, CAST(l_quantity AS INTEGER) AS score,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INTEGER) AS chain_no FROM lineitem
), ranks AS (
  SELECT *, CAST(row_number() OVER w AS INTEGER) AS chain_rank FROM z WINDOW w AS (PARTITION BY read_id ORDER BY score DESC, ref_id, pos0, qb, strand, chain_no)
), ok AS (
  SELECT *, CASE WHEN qb > 0 THEN qb || 'S' ELSE '' END || score || '=' || CASE WHEN qe < {LENGTH} THEN ({LENGTH} - qe) || 'S' ELSE '' END AS cigar, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, chain_no) AS ord
  FROM z WHERE score >= 15 AND 2 * score >= qb + 5
)"""
PLACED = f"""{ALIGNED}, k(read_id, ord, kept, stays) AS (
  SELECT read_id, ord, [ref_id * 100000 + pos0], true FROM ok WHERE ord = 1
  UNION ALL
  SELECT o.read_id, o.ord, CASE WHEN near THEN kept ELSE list_append(kept, place) END, NOT near
  FROM (SELECT k.kept, o.*, o.ref_id * 100000 + o.pos0 AS place, len(list_filter(k.kept, lambda x: abs(x - (o.ref_id * 100000 + o.pos0)) <= 5)) > 0 AS near FROM k JOIN ok o ON o.read_id = k.read_id AND o.ord = k.ord + 1) o
), a AS (
  SELECT ok.*, CAST(row_number() OVER (PARTITION BY ok.read_id ORDER BY ok.ord) - 1 AS INTEGER) AS i, count(*) OVER (PARTITION BY ok.read_id) AS n FROM ok JOIN k ON k.read_id = ok.read_id AND k.ord = ok.ord WHERE stays
)"""


def selected(soft: bool = False, smallest: bool = False) -> str:
    """The records of all reads: ``r`` mapped ones, ``every`` with the unmapped ones."""
    first = "CASE WHEN split0 > 0 AND (sref < pref OR (sref = pref AND spos < ppos)) THEN split0 ELSE 0 END" if smallest else "0"
    hard = "false" if soft else "i = split_at AND kind = 'supplementary'"
    return f"""{PLACED}, p AS (
  SELECT a.*, p.ref_id AS pref, p.pos0 AS ppos, coalesce(s.score, 0) AS second,
         a.i BETWEEN 1 AND 3 AND greatest(0, least(p.qe, a.qe) - greatest(p.qb, a.qb)) <= 13 AND greatest(0, p.qb - a.qb) + greatest(0, a.qe - p.qe) >= 9
         AND (p.qe - p.qb + a.qe - a.qb - greatest(0, least(p.qe, a.qe) - greatest(p.qb, a.qb))) * 10 >= {LENGTH} * 7 AND a.qe - a.qb >= 9 AND a.score >= 10 AS splits
  FROM a JOIN a p ON p.read_id = a.read_id AND p.i = 0 LEFT JOIN a s ON s.read_id = a.read_id AND s.i = 1
), q0 AS (
  SELECT *, coalesce(min(CASE WHEN splits THEN i END) OVER (PARTITION BY read_id), -1) AS split0 FROM p
), q1 AS (
  SELECT *, max(CASE WHEN i = split0 THEN ref_id END) OVER (PARTITION BY read_id) AS sref, max(CASE WHEN i = split0 THEN pos0 END) OVER (PARTITION BY read_id) AS spos FROM q0
), q2 AS (
  SELECT *, {first} AS first_at FROM q1
), q3 AS (
  SELECT *, CASE WHEN first_at > 0 THEN 0 ELSE split0 END AS split_at FROM q2
), q4 AS (
  SELECT *, CASE WHEN i = first_at THEN 'primary' WHEN i = split_at OR (ref_id <> pref AND score >= 10) THEN 'supplementary' ELSE 'secondary' END AS kind,
         greatest(second, read_id % 7) AS sub0, CAST(read_id % 40 AS INTEGER) AS csub, n - 1 + read_id % 3 AS sub_n, CAST(greatest(qe - qb, score) AS DOUBLE) AS size FROM q3
), q5 AS (
  SELECT *, greatest(CASE WHEN sub0 <> 0 THEN sub0 ELSE 9 END, csub) AS rival, 1.0::DOUBLE - (size - score) / 5.0::DOUBLE / size AS identity FROM q4
), q6 AS (
  SELECT *, (CASE WHEN size < 50 THEN 1.0::DOUBLE ELSE 3.912023005428146::DOUBLE / ln(size) END) * identity * identity AS weight FROM q5
), q7 AS (
  SELECT *, CAST(CASE WHEN kind <> 'primary' OR rival >= score THEN 0 ELSE greatest(0, least(60, trunc(6.02::DOUBLE * (score - rival) * weight * weight + 0.499::DOUBLE) - CASE WHEN sub_n > 0 THEN trunc(4.343::DOUBLE * ln(sub_n + 1.0::DOUBLE) + 0.499::DOUBLE) ELSE 0 END)) END AS INTEGER) AS mapq,
         {hard} AS hard, 'chr' || ref_id AS rname, max(score) OVER (PARTITION BY read_id) AS best, CASE WHEN strand = '-' THEN reverse(translate(repeat('ACGTTGCAAC', 13), 'ACGT', 'TGCA')) ELSE repeat('ACGTTGCAAC', 13) END AS turned,
         CASE WHEN strand = '-' THEN reverse(repeat('ABCDEFGHIJ', 13)) ELSE repeat('ABCDEFGHIJ', 13) END AS quals FROM q6
), x AS (
  SELECT a.read_id, a.i, string_agg(CASE WHEN o.i <> a.i AND o.kind <> 'secondary' THEN o.rname || ',' || (o.pos0 + 1) || ',' || o.strand || ',' || o.cigar || ',' || o.mapq || ',' || (o.score % 5) || ';' END, '' ORDER BY o.i) AS sa,
         string_agg(CASE WHEN o.kind = 'secondary' AND o.score > (4 * o.best + 2) // 5 THEN o.rname || ',' || o.strand || (o.pos0 + 1) || ',' || o.cigar || ',' || (o.score % 5) || ';' END, '' ORDER BY o.i) AS xa, count(CASE WHEN o.kind = 'secondary' AND o.score > (4 * o.best + 2) // 5 THEN 1 END) AS hits
  FROM q7 a JOIN q7 o ON o.read_id = a.read_id GROUP BY a.read_id, a.i
), r AS (
  SELECT q7.read_id, kind, q7.i AS idx, CAST(CASE WHEN strand = '-' THEN 16 ELSE 0 END + CASE kind WHEN 'secondary' THEN 256 WHEN 'supplementary' THEN 2048 ELSE 0 END AS INTEGER) AS flag, rname, pos0 + 1 AS pos, mapq,
         CASE WHEN hard THEN replace(cigar, 'S', 'H') ELSE cigar END AS cigar, CASE WHEN hard THEN substr(turned, qb + 1, qe - qb) ELSE turned END AS seq, CASE WHEN hard THEN substr(quals, qb + 1, qe - qb) ELSE quals END AS qual,
         CASE WHEN kind <> 'secondary' AND sa <> '' THEN 'SA:Z:' || sa END AS sa, CASE WHEN kind = 'primary' AND hits BETWEEN 1 AND 4 THEN 'XA:Z:' || xa END AS xa,
         'NM:i:' || (score % 5) || ';AS:i:' || score || ';MD:Z:' || score || CASE WHEN kind <> 'secondary' AND sa <> '' THEN ';SA:Z:' || sa ELSE '' END || CASE WHEN kind = 'primary' AND hits BETWEEN 1 AND 4 THEN ';XA:Z:' || xa ELSE '' END
         || CASE WHEN kind = 'primary' AND csub > 0 THEN ';XS:i:' || csub ELSE '' END AS tags, score, score AS ref_span
  FROM q7 JOIN x ON x.read_id = q7.read_id AND x.i = q7.i
), every AS (
  SELECT * FROM r
  UNION ALL
  SELECT o_orderkey, 'primary', 0, 4, '*', 0, 0, '*', repeat('ACGTTGCAAC', 13), repeat('ABCDEFGHIJ', 13), NULL, NULL, '', 0, 0 FROM orders WHERE o_orderkey NOT IN (SELECT read_id FROM r)
)"""


WRITTEN = """w AS (
  SELECT CAST(l_suppkey % 8 AS INTEGER) AS part, row_number() OVER (PARTITION BY l_suppkey % 8 ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS n, CASE WHEN l_returnflag = 'N' THEN CAST(l_partkey % 50 AS INTEGER) ELSE -1 END AS ref_idx,
         CAST(l_orderkey % 3000 * 37 AS INTEGER) AS pos0, CAST(l_orderkey % 3000 * 37 + 1 + CAST(l_quantity AS INTEGER) * 400 AS INTEGER) AS end0 FROM lineitem
), sizes AS (
  SELECT part, max(n) AS m, max(n) // 100 + 1 AS size FROM w GROUP BY part
), bases AS (
  SELECT part, m, size, 77 + coalesce(sum(size) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM sizes
), v AS (
  SELECT part, n, ref_idx, pos0, end0, CAST((base + n // 100) * 65536 + n % 100 * 500 AS BIGINT) AS beg, CAST(CASE WHEN n < m THEN (base + (n + 1) // 100) * 65536 + (n + 1) % 100 * 500 ELSE (base + size) * 65536 END AS BIGINT) AS "end" FROM w JOIN bases USING (part)
)"""
TRUTH = """SELECT count(*) AS reads, count(*) FILTER (m) AS mapped, count(*) FILTER (m AND abs(pos - 1 - true_pos) <= {near}) AS correct_pos, count(*) FILTER (m AND (flag & 16 <> 0) = reverse) AS correct_strand, count(*) FILTER (m AND regexp_full_match(cigar, '[0-9]+=')) AS perfect_cigar, round(avg(mapq) FILTER (m), 6) AS avg_mapq
FROM (SELECT t.*, p.flag, p.pos, p.mapq, p.cigar, coalesce(p.flag & 4 = 0, false) AS m FROM t LEFT JOIN primaries p ON p.name = t.name)"""

ORACLES = {
    "accepted_extensions": f"WITH {ALIGNED} SELECT read_id, chain_no AS chain_rank, score, cigar FROM ok",
    "near_placements": f"WITH RECURSIVE {PLACED} SELECT read_id, i, chain_no AS chain_rank, ref_id, pos0, score FROM a",
    "chain_ranks": f"WITH {ALIGNED} SELECT r.read_id, r.chain_no, r.chain_rank, s.score AS next_score, p.ref_id AS best_ref, p.qb AS best_begin FROM ranks r JOIN ranks p ON p.read_id = r.read_id AND p.chain_rank = 1 LEFT JOIN ranks s ON s.read_id = r.read_id AND s.chain_rank = 2",
    "extension_gate": f"""WITH {ALIGNED} SELECT r.read_id, r.chain_rank, r.chain_rank = 1 OR r.ref_id <> p.ref_id OR (greatest(0, least(p.qe, r.qe) - greatest(p.qb, r.qb)) <= 13 AND greatest(0, p.qb - r.qb) + greatest(0, r.qe - p.qe) >= 9) AS extend
FROM ranks r JOIN ranks p ON p.read_id = r.read_id AND p.chain_rank = 1""",
    "read_scores": f"WITH RECURSIVE {PLACED} SELECT a.read_id, a.score AS best, CAST(greatest(coalesce(s.score, 0), a.read_id % 7) AS INTEGER) AS sub, CAST(a.read_id % 40 AS INTEGER) AS csub, CAST(a.n - 1 + a.read_id % 3 AS INTEGER) AS sub_n FROM a LEFT JOIN a s ON s.read_id = a.read_id AND s.i = 1 WHERE a.i = 0",
    "record_table": f"WITH RECURSIVE {selected()} SELECT read_id, kind, idx, flag, rname, pos, mapq, cigar, seq, qual, tags, score, ref_span FROM every",
    "sa_tags": f"WITH RECURSIVE {selected()} SELECT read_id, idx, sa FROM r",
    "xa_tags": f"WITH RECURSIVE {selected()} SELECT read_id, xa FROM every WHERE kind = 'primary'",
    "cross_contig": f"WITH RECURSIVE {selected()} SELECT read_id, idx, rname, pos FROM r WHERE kind = 'supplementary'",
    "supplementary_rows": f"WITH RECURSIVE {selected()} SELECT read_id, idx, flag, mapq, cigar, seq, split_part(tags, ';', 1) AS nm FROM r WHERE kind = 'supplementary'",
    "clip_rewrite": f"WITH RECURSIVE {selected(soft=True)} SELECT read_id, idx, cigar, seq FROM r WHERE kind = 'supplementary'",
    "smallest_coordinate": f"WITH RECURSIVE {selected(smallest=True)} SELECT read_id, kind, idx, flag, rname, pos, mapq FROM every WHERE kind <> 'secondary'",
    "unmapped_rows": f"WITH RECURSIVE {selected()} SELECT read_id, kind, flag, rname, pos, mapq, cigar, seq, 0 AS n_tags FROM every WHERE flag & 4 <> 0",
    "rescue_limits": """WITH o AS (SELECT o_orderkey, o_custkey % 500 AS mean, o_custkey % 500 + 4 * (o_orderkey % 90) AS far FROM orders), l AS (SELECT o_orderkey, mean, greatest(200, CASE WHEN o_orderkey % 2 = 0 THEN least(far, 700) ELSE far END) AS reach FROM o)
SELECT o_orderkey, CAST(CASE WHEN mean >= 100 THEN reach ELSE 10000 END AS BIGINT) AS max_insert, CAST(CASE WHEN mean >= 100 THEN reach ELSE 2000 END AS BIGINT) AS "window" FROM l""",
    "length_config": f"WITH r AS (SELECT item_id AS read_id, length({DNA}) > 250 AS long FROM benchmark) SELECT read_id, 9 AS min_seed_len, CASE WHEN long THEN 10000 ELSE 500 END AS max_occ, CASE WHEN long THEN 50000 ELSE 10000 END AS max_gap, CASE WHEN long THEN 128 ELSE 32 END AS band, CASE WHEN long THEN 20 ELSE 10 END AS min_chain_score, CASE WHEN long THEN -1 ELSE -4 END AS mismatch FROM r",
    "chunk_ends": f'WITH {WRITTEN} SELECT part, n, ref_idx, beg, "end" FROM v',
    "backfill": f"""WITH {WRITTEN}, hit AS (SELECT ref_idx, unnest(range(pos0 >> 14, ((greatest(end0, pos0 + 1) - 1) >> 14) + 1)) AS win, beg FROM v WHERE ref_idx >= 0), f AS (SELECT ref_idx, win, min(beg) AS off FROM hit GROUP BY ALL),
e AS (SELECT ref_idx, unnest(range(0, m + 1)) AS win FROM (SELECT ref_idx, max(win) AS m FROM f GROUP BY ref_idx)) SELECT e.ref_idx, CAST(e.win AS INTEGER) AS win, arg_min(f.off, f.win) AS off FROM e JOIN f ON f.ref_idx = e.ref_idx AND f.win >= e.win GROUP BY e.ref_idx, e.win""",
    "accuracy_counts": f"WITH RECURSIVE {selected()}, primaries AS (SELECT 'o' || read_id AS name, * EXCLUDE (read_id) FROM every WHERE kind = 'primary'), t AS (SELECT 'o' || o_orderkey AS name, o_custkey % 2000 AS true_pos, o_orderkey % 2 = 1 AS reverse FROM orders) {TRUTH.format(near=5)}",
    "last_record": f"WITH RECURSIVE {selected()}, primaries AS (SELECT 'o' || read_id % 100 AS name, flag, pos, mapq, cigar FROM every WHERE kind = 'primary' QUALIFY row_number() OVER (PARTITION BY read_id % 100 ORDER BY read_id DESC) = 1), t AS (SELECT 'o' || i AS name, i * 20 AS true_pos, i % 2 = 1 AS reverse FROM range(100) g(i)) {TRUTH.format(near=300)}",
}
