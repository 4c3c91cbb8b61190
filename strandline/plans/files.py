"""Queries that write the file formats into the shared folder and read them back, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import sequence as S
from ..operators import alignment, index
from ..sources import bam, sam, sequences as io
from ..sources.staging import own_folder
from .mapping import BASE, KMERS
from .outputs import RECORDS, records
from .sequences import CONTIGS, DNA, contigs, read, reads, refs


def folder(spark, name: str) -> str:
    return f"{own_folder(spark)}/{name}"


def fasta_scan(spark, sf_dir):
    path = folder(spark, "fasta")
    io.write_text(io.fasta_text(refs(spark, sf_dir).withColumn("comment", F.lit("made from text"))), path)
    return io.read_fasta(spark, path).select("name", "comment", F.length("seq").alias("length"), F.md5("seq").alias("md5"))


def fastq_scan(spark, sf_dir):
    """Reads through compressed FASTQ, a file a task."""
    path = folder(spark, "fastq")
    r = reads(spark, sf_dir).withColumn("comment", F.lit("")).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    io.write_text(io.fastq_text(r), path, gzip=True)
    return io.read_records(spark, io.list_files(path, ".gz")).where("error is null").select("name", "seq", F.length("qual").alias("n_qual"))


def sam_scan(spark, sf_dir):
    path = folder(spark, "sam")
    r = records(spark, sf_dir).withColumn("kind_ord", F.lit(0)).withColumn("idx", F.lit(0))
    sam.write_sam(r, contigs(spark, sf_dir), path)
    return sam.read_sam(spark, path).select("name", "flag", "rname", "pos", "mapq", "cigar", F.array_join("tags", ";").alias("tags"))


def bam_scan(spark, sf_dir):
    path = f"{folder(spark, 'bam')}.bam"
    refs_ = contigs(spark, sf_dir)
    bam.write_bam(records(spark, sf_dir), refs_, path, "@HD\tVN:1.6\tSO:coordinate\n")
    return bam.read_bam(spark, path).select("name", "flag", "ref", "pos", "mapq", "cigar", "seq")


def index_scan(spark, sf_dir):
    """Seeds of each contig in a saved and loaded index, and the commonest seed's occurrences in the contig."""
    path = folder(spark, "index")
    index.save(contigs(spark, sf_dir), path, 19)
    _, seeds, k = index.load(spark, path)
    return seeds.groupBy("ref_id").agg(F.count("*").alias("n"), F.max("occ").alias("most"), F.lit(k).alias("k"))


def chain_cigars(spark, sf_dir):
    """CIGARs made from chains alone: an order's lines are matches with small gaps between them."""
    li = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    n = F.col("l_quantity").cast("int")
    q = F.sum(n + F.col("l_linenumber") % 3).over(order).cast("int") - n
    r = F.sum(n + (F.col("l_partkey") % 3).cast("int")).over(order).cast("int") - n
    m = li.select("l_orderkey", q.alias("qpos"), r.alias("rpos"), n.alias("len"))
    g = m.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("qpos", "rpos", "len"))).alias("mems"))
    return g.select("l_orderkey", S.chain_cigar("mems", F.lit(500)).alias("cigar"))


def pairwise_extend(spark, sf_dir):
    p = read(spark, sf_dir, "customer").select("c_custkey", S.dna("c_name").alias("q"), S.dna(F.concat("c_mktsegment", "c_name")).alias("r"))
    p = p.withColumn("sw", alignment.aligner(alignment.Scoring(), 16, "semi_global")("q", "r"))
    return p.select("c_custkey", "sw.score", "sw.cigar", "sw.nm", "sw.md")


def suffix_check(spark, sf_dir):
    """Rows of the suffix tables that are out of order or no permutation; none if they are right."""
    from .sequences import suffix_array

    s = suffix_array(spark, sf_dir)
    order = Window.partitionBy("read_id").orderBy("rank")
    s = s.withColumn("suffix", F.expr("substring(t, pos + 1)")).withColumn("before", F.lag("suffix").over(order))
    return s.groupBy("read_id").agg(F.count_if(F.col("before") >= F.col("suffix")).alias("unsorted"), (F.count("*") - F.countDistinct("pos")).alias("repeated"))


QUERIES = {f.__name__: f for f in (fasta_scan, fastq_scan, sam_scan, bam_scan, index_scan, chain_cigars, pairwise_extend, suffix_check)}

ORACLES = {
    "fasta_scan": f"WITH {CONTIGS} SELECT name, 'made from text' AS comment, CAST(length AS INTEGER) AS length, md5 FROM contigs",
    "fastq_scan": f"SELECT 'item' || item_id AS name, {DNA} AS seq, CAST(length({DNA}) AS INTEGER) AS n_qual FROM benchmark",
    "sam_scan": f"WITH {RECORDS} SELECT name, flag, rname, pos, mapq, cigar, replace(tags, chr(9), ';') AS tags FROM rec",
    "bam_scan": f"WITH {CONTIGS}, {RECORDS} SELECT rec.name, flag, CAST(coalesce(ref_id, -1) AS INTEGER) AS ref, pos - 1 AS pos, mapq, cigar, 'ACGTACGTACGTACGTACGT' AS seq FROM rec LEFT JOIN contigs c ON c.name = rname",
    "index_scan": f"WITH {BASE}, {KMERS.format(k=19)}, o AS (SELECT ref_id, kmer, count(*) AS occ FROM ref_kmers GROUP BY ALL) SELECT ref_id, CAST(sum(occ) AS BIGINT) AS n, max(occ) AS most, 19 AS k FROM o GROUP BY ref_id",
    "chain_cigars": """WITH m AS (
  SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS n, l_linenumber % 3 AS qg, CAST(l_partkey % 3 AS INTEGER) AS rg, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i FROM lineitem
), g AS (
  SELECT l_orderkey, i, CASE WHEN i = 1 THEN CASE WHEN qg > 0 THEN qg || 'S' ELSE '' END
    ELSE CASE WHEN least(qg, rg) > 0 THEN least(qg, rg) || 'M' ELSE '' END || CASE WHEN qg > rg THEN (qg - rg) || 'I' WHEN rg > qg THEN (rg - qg) || 'D' ELSE '' END END || n || 'M' AS part, n, qg FROM m
), t AS (
  SELECT l_orderkey, string_agg(part, '' ORDER BY i) AS cigar, 500 - sum(n + qg) AS tail FROM g GROUP BY l_orderkey
)
SELECT l_orderkey, cigar || CASE WHEN tail > 0 THEN CAST(tail AS BIGINT) || 'S' ELSE '' END AS cigar FROM t""",
    "suffix_check": "SELECT item_id AS read_id, CAST(0 AS BIGINT) AS unsorted, CAST(0 AS BIGINT) AS repeated FROM benchmark",
}
