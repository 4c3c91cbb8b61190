"""Queries that seed, chain, align and pair reads, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import Config, preset
from ..functions import sequence as S
from ..operators import alignment, chaining, mapping, pairing, seeding
from ..sources import sam, sequences as io
from ..sources.staging import staged
from .sequences import DNA, contigs, read, reads, refs

K = 19
MAX_OCC = 500


def hits(spark, sf_dir) -> DataFrame:
    return seeding.seed_hits(reads(spark, sf_dir), refs(spark, sf_dir), K)


def mems(spark, sf_dir) -> DataFrame:
    return seeding.maximal_matches(hits(spark, sf_dir), K)


def seed_join(spark, sf_dir):
    """Shared k-mers of each read, strand and contig, with sums that fix their places."""
    h = hits(spark, sf_dir).groupBy("read_id", "strand", "ref_id")
    return h.agg(F.count("*").alias("n"), F.sum("qpos").alias("sum_qpos"), F.sum("rpos").alias("sum_rpos"))


def mem_islands(spark, sf_dir):
    return mems(spark, sf_dir).select("read_id", "strand", "ref_id", "qpos", "rpos", "len")


def best_hit(spark, sf_dir):
    b = seeding.best_hit(mems(spark, sf_dir))
    return b.select("read_id", F.concat(F.lit("doc"), F.col("ref_id").cast("string")).alias("rname"), "strand", (F.col("rpos") + 1).alias("pos"), "qpos", "len", F.concat(F.col("len").cast("string"), F.lit("=")).alias("cigar"))


def kmer_counts(spark, sf_dir):
    """The commonest 12-mers of the contigs: 100, ties to the smaller one."""
    from ..operators.index import kmers

    n = kmers(refs(spark, sf_dir), ["ref_id"], 12).groupBy("kmer").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "kmer").limit(100)


def unique_kmers(spark, sf_dir):
    """Reads by how many of their 20-mers occur exactly once in the contigs."""
    from ..operators.index import kmers

    once = kmers(refs(spark, sf_dir), ["ref_id"], 20).groupBy("kmer").agg(F.count("*").alias("n")).where("n = 1")
    q = kmers(reads(spark, sf_dir), ["read_id"], 20)
    return q.join(once, "kmer", "left_semi").groupBy("read_id").agg(F.count("*").alias("n_unique"))


def pattern_counts(spark, sf_dir):
    """How often each window of 19 bases of each read occurs in all contigs."""
    from ..operators.index import reference

    p = seeding.read_kmers(reads(spark, sf_dir), K, ("read_id",))
    n = reference(refs(spark, sf_dir)).kmers(K).join(p.select("kmer").distinct(), "kmer", "left_semi").groupBy("kmer").agg(F.count("*").alias("n"))
    return p.join(n, "kmer", "left").select("read_id", "qpos", F.coalesce("n", F.lit(0)).alias("n"))


def occurrence_cap(spark, sf_dir):
    m = seeding.capped(mems(spark, sf_dir), K, MAX_OCC)
    return m.select("read_id", "strand", "ref_id", "qpos", "rpos", "len", "occ")


def containment(spark, sf_dir):
    """Matches of reads in contigs that do not lie within longer ones of the read, on one strand and diagonal."""
    return seeding.uncontained(mems(spark, sf_dir)).select("read_id", "strand", "ref_id", "qpos", "rpos", "len")


def strand_coverage(spark, sf_dir):
    return seeding.coverage(mems(spark, sf_dir), ["read_id", "strand"])


def inexact_gate(spark, sf_dir):
    return seeding.needs_inexact(mems(spark, sf_dir), reads(spark, sf_dir))


def strand_vote(spark, sf_dir):
    return seeding.strand_vote(mems(spark, sf_dir))


def one_mismatch(spark, sf_dir):
    s = seeding.inexact_seeds(reads(spark, sf_dir), refs(spark, sf_dir), staged(mems(spark, sf_dir)), K, MAX_OCC)
    return s.select("read_id", "strand", "ref_id", "qpos", "rpos", "inexact")


def rescue_kmers(spark, sf_dir):
    """Seeds of five and of four bases of reads without any match, by contig."""
    return seeding.rescue_counts(reads(spark, sf_dir), refs(spark, sf_dir), mems(spark, sf_dir), MAX_OCC)


def mems_per_contig(spark, sf_dir):
    """Matches of every contig, those without any included."""
    n = mems(spark, sf_dir).groupBy("ref_id").agg(F.count("*").alias("n"))
    return refs(spark, sf_dir).select("ref_id").join(n, "ref_id", "left").select("ref_id", F.coalesce("n", F.lit(0)).alias("n"))


def chain_edges(spark, sf_dir):
    e = seeding.chain_edges(mems(spark, sf_dir), 10_000)
    return e.select("read_id", "strand", "ref_id", "q1", "r1", "q2", "r2", "qgap", "rgap")


def chain_table(spark, sf_dir):
    c = chaining.ranked(chaining.chains(mems(spark, sf_dir), 10_000, 10))
    return c.select("read_id", "strand", "ref_id", "chain_rank", "score", "query_begin", "query_end", "ref_begin", "ref_end", F.size("mems").alias("n_mems"))


def _records(spark, sf_dir, cfg=None) -> DataFrame:
    return mapping.align_single(reads(spark, sf_dir), refs(spark, sf_dir), cfg or preset("intractable"))


def align_reads(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("read_id", "kind", "flag", "rname", "pos", "mapq", "cigar", "score", F.array_join("tags", "\t").alias("tags"))


def align_all(spark, sf_dir):
    from dataclasses import replace

    r = _records(spark, sf_dir, replace(preset("intractable"), output_secondary=True, mark_split_secondary=True, soft_clip_supplementary=True, smallest_coord_primary=True))
    return r.select("read_id", "kind", "flag", "rname", "pos", "mapq", "cigar", "score")


def sam_lines(spark, sf_dir):
    return sam.sam_rows(_records(spark, sf_dir)).select("read_id", "kind_ord", "idx", "value")


def streamed_reads(spark, sf_dir):
    """The reads as files that arrive, mapped batch by batch by the streaming job."""
    from ..sources.staging import own_folder
    from ..streaming.align import align_stream

    at = own_folder(spark)
    reads(spark, sf_dir).select("read_id", "name", "seq", "qual").repartition(4, "read_id").write.parquet(f"{at}/in")
    align_stream(spark, f"{at}/in", refs(spark, sf_dir), f"{at}/out", f"{at}/state", preset("intractable"), files=2).awaitTermination()
    return spark.read.parquet(f"{at}/out").select("read_id", "kind", "flag", "rname", "pos", "mapq", "cigar", "score")


def align_mates(spark, sf_dir):
    """Every read cut in two: its first half and its reversed second half are mates."""
    r, half = reads(spark, sf_dir), F.ceil(F.length("seq") / 2).cast("int")
    one = r.select(F.col("read_id").alias("pair_id"), F.lit(1).alias("mate"), "name", F.substring("seq", F.lit(1), half).alias("seq"), "qual")
    two = r.select(F.col("read_id").alias("pair_id"), F.lit(2).alias("mate"), "name", S.reverse_complement(F.substring("seq", half + 1, F.length("seq"))).alias("seq"), "qual")
    rows = pairing.align_pairs(one.unionByName(two), refs(spark, sf_dir), preset("intractable"))
    return rows.select("pair_id", "mate", "kind", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen")


def simulated_accuracy(spark, sf_dir):
    """Simulated reads from the contigs, mapped and compared with their true places."""
    c = contigs(spark, sf_dir)
    truth = staged(io.simulate(c, 200, 120, 0.01))
    rows = mapping.align_single(truth.select("read_id", "name", "seq", "qual"), c, preset("intractable"), rescue=False)
    return io.accuracy(rows.withColumn("line_no", F.col("kind_ord")), truth)


def simulated_reads(spark, sf_dir):
    return io.simulate(contigs(spark, sf_dir), 200, 120, 0.01).select("read_id", "ref_id", "pos", "reverse", "seq")


def pairwise_local(spark, sf_dir):
    """Part names against each other's neighbours, as sequences, by the local kernel."""
    p = read(spark, sf_dir, "part").select("p_partkey", S.dna("p_name").alias("q"), S.dna(F.concat("p_type", "p_name")).alias("r"))
    p = p.withColumn("sw", alignment.aligner(Config().scoring, 0, "local")("q", "r"))
    return p.select("p_partkey", "sw.score", "sw.cigar", "sw.ref_begin", "sw.ref_end")


def pairwise_global(spark, sf_dir):
    p = read(spark, sf_dir, "supplier").select("s_suppkey", S.dna("s_name").alias("q"), S.dna(F.concat("s_name", F.col("s_nationkey").cast("string"))).alias("r"))
    p = p.withColumn("sw", alignment.aligner(Config().scoring, 0, "global")("q", "r"))
    return p.select("s_suppkey", "sw.score", "sw.cigar")


# Relational stand-ins: lines 1 and 2 of an order are mates, part keys are positions.


def mates(spark, sf_dir) -> DataFrame:
    li = read(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    span = F.col("l_quantity").cast("int")
    return li.select(F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").cast("int").alias("mate"), (F.col("l_suppkey") % 3).cast("int").alias("ref_id"), F.col("l_partkey").alias("pos"), (F.col("l_returnflag") == "R").alias("rev"), span.alias("span"), (F.col("l_quantity") + 10).cast("int").alias("mapq"))


def mate_pairs(spark, sf_dir) -> DataFrame:
    m = mates(spark, sf_dir)
    side = lambda n: F.max(F.when(F.col("mate") == n, F.struct("ref_id", "pos", "rev", "span", "mapq")))
    p = m.groupBy("pair_id").agg(side(1).alias("a"), side(2).alias("b")).where("a is not null and b is not null")
    five = lambda x: S.five_prime(f"{x}.pos", f"{x}.rev", f"{x}.span")
    p = p.withColumn("insert", F.abs(five("a") - five("b")) + 1)
    return p.withColumn("facing", (F.col("a.ref_id") == F.col("b.ref_id")) & pairing.forward_reverse(F.col("a.pos"), F.col("a.rev"), F.col("b.pos"), F.col("b.rev")))


def proper_pairs(spark, sf_dir):
    return mate_pairs(spark, sf_dir).select("pair_id", "insert", "facing", (F.col("facing") & (F.col("insert") <= 800)).alias("proper"))


def insert_moments(spark, sf_dir):
    """Trimmed moments of the clean pairs among the first 512 pair ids."""
    p = mate_pairs(spark, sf_dir).where(F.col("facing") & (F.col("a.mapq") >= 20) & (F.col("b.mapq") >= 20))
    m = pairing.trimmed_moments(p, "insert", "pair_id")
    return m.select(F.col("n").alias("n_pairs"), F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def interleaved_pairs(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    p = pairing.interleaved(e, "event_id")
    side = lambda n: F.max(F.when(F.col("mate") == n, F.col("event_type")))
    return p.groupBy("pair_id").agg(side(1).alias("first"), side(2).alias("second"))


def zipped_pairs(spark, sf_dir):
    one = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"))
    two = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"))
    return pairing.zipped(one, two).select("pair_id", "mate", "name")


def spans(spark, sf_dir) -> DataFrame:
    """Lines of an order as segments of a read, best first."""
    li = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy(F.desc("l_quantity"), "l_linenumber", "l_partkey", "l_suppkey")
    qb = (F.col("l_partkey") % 80).cast("int")
    s = li.select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("score"), (F.col("l_suppkey") % 4).cast("int").alias("ref_id"), qb.alias("qb"), (qb + F.col("l_quantity").cast("int")).alias("qe"), F.col("l_partkey").alias("pos"), F.row_number().over(order).alias("rank"))
    first = Window.partitionBy("l_orderkey").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = F.struct("ref_id", "qb", "qe", "pos", F.lit(130).alias("query_len"), "score")
    return s.withColumn("p", F.first(p).over(first)).withColumn("best", F.max("score").over(first))


def split_segments(spark, sf_dir):
    """The first of the next three segments that covers what the primary leaves."""
    s = spans(spark, sf_dir).where("rank between 2 and 4")
    s = s.where(mapping.is_split(F.col("p"), F.struct("qb", "qe", "score"), Config()))
    first = Window.partitionBy("l_orderkey").orderBy("rank")
    return s.withColumn("n", F.row_number().over(first)).where("n = 1").select("l_orderkey", "rank", "qb", "qe")


QUERIES = {
    f.__name__: f
    for f in (
        seed_join, mem_islands, best_hit, kmer_counts, unique_kmers, pattern_counts, occurrence_cap, containment, strand_coverage, inexact_gate, strand_vote, one_mismatch, rescue_kmers, mems_per_contig, chain_edges, chain_table,
        align_reads, align_all, streamed_reads, sam_lines, align_mates, simulated_accuracy, simulated_reads, pairwise_local, pairwise_global, proper_pairs, insert_moments, interleaved_pairs, zipped_pairs, 
        split_segments, 
    )
}

RC = "reverse(translate(seq, 'ACGT', 'TGCA'))"
# Long sequences are cut into pieces of 1000 bases that overlap by k - 1 before windows are taken.
KMERS = """pieces AS (
  SELECT ref_id, o, substr(seq, o + 1, 999 + {k}) AS s FROM (SELECT ref_id, seq, unnest(range(0, length(seq) - {k} + 1, 1000)) AS o FROM refs WHERE length(seq) >= {k})
), ref_kmers AS (
  SELECT * FROM (SELECT ref_id, CAST(o + i AS INTEGER) AS rpos, substr(s, i + 1, {k}) AS kmer FROM (SELECT ref_id, o, s, unnest(range(0, length(s) - {k} + 1)) AS i FROM pieces)) WHERE NOT contains(kmer, 'N')
)"""
BASE = f"""refs AS (
  SELECT * FROM (SELECT doc_id AS ref_id, {DNA} AS seq FROM documents) WHERE seq <> ''
), reads AS (
  SELECT item_id AS read_id, {DNA} AS seq FROM benchmark
), sides AS (
  SELECT read_id, '+' AS strand, seq FROM reads UNION ALL SELECT read_id, '-' AS strand, {RC} AS seq FROM reads
)"""
HITS = f"""{BASE}, {KMERS.format(k=K)}, read_kmers AS (
  SELECT * FROM (SELECT read_id, strand, CAST(i AS INTEGER) AS qpos, substr(seq, i + 1, {K}) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - {K} + 1)) AS i FROM sides)) WHERE NOT contains(kmer, 'N')
), hits AS (
  SELECT read_id, strand, ref_id, qpos, rpos FROM ref_kmers JOIN read_kmers USING (kmer)
)"""
MEMS = f"""{HITS}, islands AS (
  SELECT *, rpos - qpos AS diag, qpos - row_number() OVER (PARTITION BY read_id, strand, ref_id, rpos - qpos ORDER BY qpos) AS island FROM hits
), mems AS (
  SELECT read_id, strand, ref_id, min(qpos) AS qpos, min(rpos) AS rpos, CAST(count(*) + {K - 1} AS INTEGER) AS len FROM islands GROUP BY read_id, strand, ref_id, diag, island
)"""
COVER = f"""{MEMS}, reach AS (
  SELECT *, max(qpos + len) OVER (PARTITION BY read_id, strand ORDER BY qpos, len ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM mems
), cover AS (
  SELECT read_id, strand, CAST(sum(greatest(0, qpos + len - greatest(qpos, coalesce(reach, qpos)))) AS BIGINT) AS covered FROM reach GROUP BY ALL
), gate AS (
  SELECT s.read_id, s.strand FROM sides s LEFT JOIN cover c ON c.read_id = s.read_id AND c.strand = s.strand WHERE 2 * coalesce(covered, 0) < length(seq)
)"""
PAIRS = """every AS (
  SELECT l_orderkey AS pair_id, l_linenumber AS mate, CAST(l_suppkey % 3 AS INTEGER) AS ref_id, l_partkey AS pos, l_returnflag = 'R' AS rev, CAST(l_quantity AS INTEGER) AS span, CAST(l_quantity + 10 AS INTEGER) AS mapq FROM lineitem WHERE l_linenumber <= 2
), m AS (
  SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY pair_id, mate ORDER BY ref_id DESC, pos DESC, rev DESC, span DESC, mapq DESC) = 1
), f AS (
  SELECT *, CASE WHEN rev THEN pos + span - 1 ELSE pos END AS five FROM m
), pairs AS (
  SELECT a.pair_id, abs(a.five - b.five) + 1 AS "insert", a.ref_id = b.ref_id AND a.rev <> b.rev AND CASE WHEN a.rev THEN b.pos <= a.pos ELSE a.pos <= b.pos END AS facing, a.mapq AS qa, b.mapq AS qb
  FROM f a JOIN f b ON a.pair_id = b.pair_id AND a.mate = 1 AND b.mate = 2
)"""
SPANS = """z AS (
  SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INTEGER) AS score, CAST(l_suppkey % 4 AS INTEGER) AS ref_id, CAST(l_partkey % 80 AS INTEGER) AS qb, CAST(l_partkey % 80 + l_quantity AS INTEGER) AS qe, l_partkey AS pos,
         CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS rank FROM lineitem
), s AS (
  SELECT z.*, p.ref_id AS pref, p.qb AS pqb, p.qe AS pqe, p.score AS best, greatest(0, least(p.qe, z.qe) - greatest(p.qb, z.qb)) AS ov, greatest(0, p.qb - z.qb) + greatest(0, z.qe - p.qe) AS ext
  FROM z JOIN z p ON p.l_orderkey = z.l_orderkey AND p.rank = 1
)"""

DIGIT = "CAST('0x' || substr(md5(concat_ws(':', {0})), 1, 7) AS BIGINT)"
SIMULATED = f"""starts AS (
  SELECT ref_id, seq, length(seq) - 119 AS n FROM refs WHERE length(seq) >= 120
), sums AS (
  SELECT *, coalesce(sum(n) OVER (ORDER BY ref_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base, sum(n) OVER () AS total FROM starts
), drawn AS (
  SELECT i AS read_id, ({DIGIT.format("'7', i")} * 268435456 + {DIGIT.format("'7', i, 'b'")}) % (SELECT any_value(total) FROM sums)::BIGINT AS place, {DIGIT.format("'7', i, 'strand'")} % 2 = 1 AS reverse FROM range(200) g(i)
), clean AS (
  SELECT read_id, ref_id, CAST(place - base AS INTEGER) AS pos, reverse, substr(seq, CAST(place - base AS BIGINT) + 1, 120) AS s FROM drawn JOIN sums ON place >= base AND place < base + n
), bases AS (
  SELECT read_id, ref_id, pos, reverse, j, substr(CASE WHEN reverse THEN reverse(translate(s, 'ACGT', 'TGCA')) ELSE s END, j + 1, 1) AS c FROM clean, range(120) g(j)
), noisy AS (
  SELECT *, CASE WHEN c <> 'N' AND {DIGIT.format("'7', read_id, j, 'e'")} < 2684354 THEN substr('ACGT', (instr('ACGT', c) + {DIGIT.format("'7', read_id, j, 's'")} % 3) % 4 + 1, 1) ELSE c END AS d FROM bases
)"""
ONE_MISMATCH = """{name}q AS (
  SELECT k.* FROM read_kmers k JOIN gate g ON g.read_id = k.read_id AND g.strand = k.strand
  WHERE k.strand = '{strand}' AND NOT EXISTS (SELECT 1 FROM ({covering}) m WHERE m.read_id = k.read_id AND k.qpos >= m.qpos AND k.qpos < m.qpos + m.len)
), {name}v AS (
  SELECT *, -1 AS mm, '=' AS base, kmer AS x FROM {name}q
  UNION ALL
  SELECT q.*, mm, base, substr(kmer, 1, mm) || base || substr(kmer, mm + 2) AS x FROM {name}q q, (SELECT unnest(range(0, {k})) AS mm), (SELECT unnest(['A', 'C', 'G', 'T']) AS base) WHERE substr(kmer, mm + 1, 1) <> base
), {name}h AS (
  SELECT *, row_number() OVER (PARTITION BY read_id, strand, qpos, ref_id ORDER BY mm, base) AS n FROM {name}v JOIN r USING (x)
), {name} AS (
  SELECT read_id, strand, ref_id, qpos, rpos, mm >= 0 AS inexact FROM {name}h WHERE n = 1
)"""
RESCUE = """p{k} AS (
  SELECT ref_id, substr(s, i + 1, {k}) AS kmer FROM (SELECT ref_id, s, unnest(range(0, length(s) - {k} + 1)) AS i FROM (SELECT ref_id, substr(seq, o + 1, {more}) AS s FROM (SELECT ref_id, seq, unnest(range(0, length(seq) - {k} + 1, 1000)) AS o FROM refs WHERE length(seq) >= {k})))
), r{k} AS (
  SELECT ref_id, kmer, count(*) AS occ FROM p{k} WHERE NOT contains(kmer, 'N') GROUP BY ALL HAVING count(*) <= {most}
), q{k} AS (
  SELECT read_id, substr(seq, i + 1, {k}) AS kmer, count(*) AS n FROM (SELECT *, unnest(range(0, length(seq) - {k} + 1)) AS i FROM reads WHERE read_id NOT IN (SELECT read_id FROM mems)) GROUP BY ALL
), s{k} AS (
  SELECT read_id, ref_id, {k} AS k, CAST(sum(n) AS BIGINT) AS seeds FROM r{k} JOIN q{k} USING (kmer) GROUP BY ALL
)"""

ORACLES = {
    "seed_join": f"WITH {HITS} SELECT read_id, strand, ref_id, count(*) AS n, CAST(sum(qpos) AS BIGINT) AS sum_qpos, CAST(sum(rpos) AS BIGINT) AS sum_rpos FROM hits GROUP BY ALL",
    "mem_islands": f"WITH {MEMS} SELECT * FROM mems",
    "best_hit": f"WITH {MEMS}, b AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY len DESC, ref_id, strand, rpos, qpos) AS n FROM mems) SELECT read_id, 'doc' || ref_id AS rname, strand, rpos + 1 AS pos, qpos, len, len || '=' AS cigar FROM b WHERE n = 1",
    "kmer_counts": f"WITH {BASE}, {KMERS.format(k=12)} SELECT kmer, count(*) AS n FROM ref_kmers GROUP BY kmer ORDER BY n DESC, kmer LIMIT 100",
    "unique_kmers": f"WITH {BASE}, {KMERS.format(k=20)}, q AS (SELECT read_id, substr(seq, i + 1, 20) AS kmer FROM (SELECT *, unnest(range(0, length(seq) - 19)) AS i FROM reads)) SELECT read_id, count(*) AS n_unique FROM q WHERE NOT contains(kmer, 'N') AND kmer IN (SELECT kmer FROM ref_kmers GROUP BY kmer HAVING count(*) = 1) GROUP BY read_id",
    "pattern_counts": f"WITH {HITS}, n AS (SELECT kmer, count(*) AS n FROM ref_kmers GROUP BY kmer) SELECT read_id, qpos, coalesce(n, 0) AS n FROM read_kmers LEFT JOIN n USING (kmer) WHERE strand = '+'",
    "occurrence_cap": f"""WITH {MEMS}, o AS (SELECT *, count(*) OVER (PARTITION BY read_id, strand, ref_id, qpos, len) AS occ, row_number() OVER (PARTITION BY read_id, strand, ref_id, qpos, len ORDER BY rpos) AS n FROM mems)
SELECT read_id, strand, ref_id, qpos, rpos, len, occ FROM o WHERE len >= {K} AND occ <= {MAX_OCC} AND n <= CASE WHEN len >= {2 * K} THEN 4 ELSE 1 END""",
    "containment": f"""WITH {MEMS} SELECT * FROM mems m WHERE NOT EXISTS (SELECT 1 FROM mems o WHERE o.read_id = m.read_id AND o.strand = m.strand AND o.ref_id = m.ref_id AND o.rpos - o.qpos = m.rpos - m.qpos
  AND o.qpos <= m.qpos AND o.qpos + o.len >= m.qpos + m.len AND o.len > m.len)""",
    "strand_coverage": f"WITH {COVER} SELECT * FROM cover",
    "inexact_gate": f"WITH {COVER} SELECT * FROM gate",
    "strand_vote": f"WITH {MEMS}, v AS (SELECT read_id, CAST(coalesce(sum(len) FILTER (strand = '+'), 0) AS BIGINT) AS forward, CAST(coalesce(sum(len) FILTER (strand = '-'), 0) AS BIGINT) AS backward FROM mems GROUP BY read_id) SELECT *, backward > forward AS reverse FROM v",
    "one_mismatch": f"""WITH {COVER}, r AS (
  SELECT kmer AS x, ref_id, min(rpos) AS rpos FROM ref_kmers GROUP BY ALL HAVING count(*) <= {MAX_OCC}
), {ONE_MISMATCH.format(name="f", strand="+", k=K, covering="SELECT read_id, qpos, len FROM mems WHERE strand = '+'")},
{ONE_MISMATCH.format(name="b", strand="-", k=K, covering=f"SELECT read_id, qpos, len FROM mems UNION ALL SELECT read_id, qpos, {K} FROM f")}
SELECT * FROM f UNION ALL SELECT * FROM b""",
    "rescue_kmers": f"WITH {MEMS}, " + ", ".join(RESCUE.format(k=k, more=999 + k, most=20 * MAX_OCC) for k in (5, 4)) + " SELECT * FROM s5 UNION ALL SELECT * FROM s4",
    "mems_per_contig": f"WITH {MEMS} SELECT refs.ref_id, count(mems.read_id) AS n FROM refs LEFT JOIN mems ON mems.ref_id = refs.ref_id GROUP BY refs.ref_id",
    "chain_edges": f"""WITH {MEMS} SELECT a.read_id, a.strand, a.ref_id, a.qpos AS q1, a.rpos AS r1, b.qpos AS q2, b.rpos AS r2, b.qpos - a.qpos - a.len AS qgap, b.rpos - a.rpos - a.len AS rgap FROM mems a JOIN mems b ON a.read_id = b.read_id AND a.strand = b.strand AND a.ref_id = b.ref_id
WHERE b.qpos - a.qpos - a.len BETWEEN 0 AND 10000 AND b.rpos - a.rpos - a.len BETWEEN 0 AND 10000""",
    "simulated_reads": f"WITH {BASE}, {SIMULATED} SELECT read_id, ref_id, pos, reverse, string_agg(d, '' ORDER BY j) AS seq FROM noisy GROUP BY ALL",
    "proper_pairs": f'WITH {PAIRS} SELECT pair_id, "insert", facing, facing AND "insert" <= 800 AS proper FROM pairs',
    "insert_moments": f"""WITH {PAIRS}, c AS (SELECT "insert" AS v, pair_id FROM pairs WHERE facing AND qa >= 20 AND qb >= 20 AND pair_id < 512), r AS (SELECT v, row_number() OVER (ORDER BY v, pair_id) AS k, count(*) OVER () AS n FROM c)
SELECT n AS n_pairs, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std FROM r WHERE n >= 20 AND k > n // 10 AND k <= n - n // 10 GROUP BY n""",
    "interleaved_pairs": "SELECT event_id // 2 AS pair_id, max(event_type) FILTER (event_id % 2 = 0) AS first, max(event_type) FILTER (event_id % 2 = 1) AS second FROM events GROUP BY ALL",
    "zipped_pairs": "SELECT c_custkey AS pair_id, 1 AS mate, c_name AS name FROM customer SEMI JOIN supplier ON s_suppkey = c_custkey UNION ALL SELECT s_suppkey, 2, s_name FROM supplier SEMI JOIN customer ON s_suppkey = c_custkey",
    "split_segments": f"""WITH {SPANS}, t AS (SELECT l_orderkey, rank, qb, qe, row_number() OVER (PARTITION BY l_orderkey ORDER BY rank) AS n FROM s WHERE rank BETWEEN 2 AND 4 AND ov <= 13 AND ext >= 9 AND (pqe - pqb + qe - qb - ov) * 10 >= 910 AND qe - qb >= 9 AND score >= 10)
SELECT l_orderkey, rank, qb, qe FROM t WHERE n = 1""",
}
