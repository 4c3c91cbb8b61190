"""Queries on sequences, contigs and scalar functions, with their SQL.

``documents`` stand in for contigs and ``benchmark`` for reads: their letters are mapped to bases.  Columns of the
business tables stand in for positions, lengths and scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import sequence as S
from ..operators import index

LETTERS, BASES = S.LETTERS, S.BASES
DNA = f"translate(lower(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')), '{LETTERS}', '{BASES}')"
CONTIGS = f"""d AS (
  SELECT doc_id AS ref_id, {DNA} AS seq FROM documents
), contigs AS (
  SELECT ref_id, 'doc' || ref_id AS name, CAST(length(seq) AS BIGINT) AS length,
         CAST(coalesce(sum(length(seq)) OVER (ORDER BY ref_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", md5(seq) AS md5, seq
  FROM d WHERE length(seq) > 0
)"""


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    # A table of one small file is one task otherwise.
    return df.repartition(spark.sparkContext.defaultParallelism) if df.rdd.getNumPartitions() < 2 else df


def contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return index.contigs(d.select(F.col("doc_id").alias("ref_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), S.dna_batches("text").alias("seq")))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs without offsets, where these are not asked for."""
    d = read(spark, sf_dir, "documents")
    # An explode drops empty sequences; a filter would make Spark derive each sequence twice.
    seq = F.explode(F.filter(F.array(S.dna_batches("text")), lambda x: x != ""))
    return d.select(F.col("doc_id").alias("ref_id"), F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("name"), seq.alias("seq"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = read(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("read_id"), F.concat(F.lit("item"), F.col("item_id").cast("string")).alias("name"), S.dna("text").alias("seq"), F.lit("").alias("qual"))


def contig_table(spark, sf_dir):
    return contigs(spark, sf_dir).drop("seq")


def total_length(spark, sf_dir):
    return contigs(spark, sf_dir).agg(F.sum("length").alias("total_length"), F.count("*").alias("n_contigs"))


def added_contigs(spark, sf_dir):
    """Contigs with part names appended as more of them: offsets go on where the last one ends."""
    p = read(spark, sf_dir, "part").select((F.col("p_partkey") + 1_000_000_000).alias("ref_id"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("name"), S.dna("p_name").alias("seq"))
    return index.add_contig(contigs(spark, sf_dir), p).drop("seq")


def encode_bases(spark, sf_dir):
    r = reads(spark, sf_dir).select("read_id", S.encode("seq").alias("codes"))
    return r.select("read_id", "codes", S.decode("codes").alias("bases"))


def reverse_complements(spark, sf_dir):
    return refs(spark, sf_dir).select("ref_id", S.reverse_complement("seq").alias("rc"))


def contig_md5(spark, sf_dir):
    return refs(spark, sf_dir).select("ref_id", F.md5(F.upper("seq")).alias("md5"))


def normalize_bases(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", S.normalize("p_name").alias("seq"))


def positions(spark, sf_dir):
    """Global positions, hash-spread over the contigs."""
    total = F.lit(contigs(spark, sf_dir).agg(F.sum("length")).first()[0])
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", ((F.col("o_orderkey") * 7919) % total).alias("position"))


def locate_sequence(spark, sf_dir):
    return index.locate(positions(spark, sf_dir), contigs(spark, sf_dir)).select("o_orderkey", "position", "ref_id", "local")


def extract_ref(spark, sf_dir):
    p = positions(spark, sf_dir).select("o_orderkey", F.col("position").alias("start"), (F.col("position") + 40).alias("end"))
    return index.extract(p, contigs(spark, sf_dir)).select("o_orderkey", "start", "ref_id", "bases")


def random_bases(spark, sf_dir):
    from ..sources.sequences import random_sequences

    return random_sequences(spark, 50, 200, "42", 10_000)


def cigar_pack(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    p = li.select("l_orderkey", "l_linenumber", S.pack_op(F.pmod("l_partkey", F.lit(9)).cast("int"), F.col("l_quantity").cast("int")).alias("packed"))
    return p.withColumn("op_len", S.op_length("packed")).withColumn("op", S.op_char(S.op_code("packed")))


def order_cigars(spark, sf_dir):
    """A CIGAR per order from its lines."""
    li = read(spark, sf_dir, "lineitem")
    op = F.struct("l_linenumber", "l_partkey", F.substring(F.lit(S.OPS), (F.pmod("l_partkey", F.lit(9)) + 1).cast("int"), F.lit(1)).alias("op"), F.col("l_quantity").cast("int").alias("len"))
    return li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(op)).alias("ops"))


def cigar_format(spark, sf_dir):
    return order_cigars(spark, sf_dir).select("l_orderkey", S.format_cigar("ops").alias("cigar"))


def cigar_parse(spark, sf_dir):
    c = cigar_format(spark, sf_dir).select("l_orderkey", F.posexplode(S.parse_cigar("cigar")).alias("i", "o"))
    return c.select("l_orderkey", "i", F.col("o.op").alias("op"), F.col("o.len").alias("len"))


def cigar_spans(spark, sf_dir):
    o = order_cigars(spark, sf_dir)
    gaps = F.size(F.filter("ops", lambda x: x["op"].isin("I", "D")))
    return o.select("l_orderkey", S.reference_span("ops").alias("ref_span"), S.query_span("ops").alias("query_span"), S.edit_count("ops").alias("nm"), S.cigar_sum("ops", "X").alias("n_mismatch"), gaps.alias("n_gap_open"), S.cigar_sum("ops", "ID").alias("n_gap_base"))


def bins(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    beg = F.col("l_orderkey") * 1009
    return li.select("l_orderkey", "l_linenumber", S.reg2bin(beg, beg + (F.col("l_quantity") * F.col("l_quantity") * 60).cast("long") + 1).alias("bin"))


def mapping_quality(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    score = (F.col("l_quantity") * 3).cast("int")
    sub, csub = (F.col("l_partkey") % 90).cast("int"), (F.col("l_suppkey") % 40).cast("int")
    size = score + (F.col("l_linenumber") * 2).cast("int")
    return li.select("l_orderkey", "l_linenumber", S.mapq(score, sub, csub, F.col("l_linenumber") - 1, size, size - 1).alias("mapq"))


def sam_flags(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    bit = lambda c, n: (F.col(c) % n) == 0
    f = S.flag(paired=F.lit(True), proper=bit("l_partkey", 2), unmapped=bit("l_partkey", 7), mate_unmapped=bit("l_suppkey", 5), reverse=F.col("l_returnflag") == "R", mate_reverse=F.col("l_linestatus") == "O", first=F.col("l_linenumber") == 1, second=F.col("l_linenumber") == 2, secondary=bit("l_orderkey", 11), supplementary=bit("l_orderkey", 6))
    r = li.select("l_orderkey", "l_linenumber", f.alias("flag"))
    return r.withColumn("rewritten", S.split_as_secondary("flag")).withColumn("is_reverse", S.has_flag("flag", "reverse"))


def template_lengths(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    own = S.five_prime(F.col("l_partkey"), F.col("l_returnflag") == "R", F.col("l_quantity").cast("int"))
    mate = S.five_prime(F.col("l_suppkey") * 20, F.col("l_linestatus") == "O", F.col("l_quantity").cast("int"))
    return li.select("l_orderkey", "l_linenumber", own.alias("five"), S.template_length(own, mate).alias("tlen"))


def phred(spark, sf_dir):
    b = read(spark, sf_dir, "part").select("p_partkey", S.phred_values("p_name").alias("v"))
    return b.select("p_partkey", F.aggregate("v", F.lit(0), lambda s, x: s + x).alias("total"), S.phred_text("v").alias("text"))


def byte_sizes(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", S.format_bytes((F.col("o_totalprice") * F.col("o_custkey")).cast("long")).alias("size"))


def header_parts(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", S.header_name("text").alias("name"), F.length(S.header_comment("text")).alias("comment_length"))


def fasta_lines(spark, sf_dir):
    r = refs(spark, sf_dir)
    return r.select("ref_id", F.concat(F.lit(">"), F.col("name"), F.lit("\n"), S.wrapped("seq", 80)).alias("fasta"))


def string_functions(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", F.concat("c_name", F.lit("|"), F.col("c_nationkey").cast("string")).alias("joined"), F.instr("c_name", "#").alias("found"), F.substring("c_name", 2, 5).alias("part"), F.rpad("c_mktsegment", 12, "_").alias("padded"), F.length("c_name").alias("size"), F.format_string("%08d", "c_custkey").alias("number"), (F.col("c_name") < F.col("c_mktsegment")).alias("less"))


def container_functions(spark, sf_dir):
    """Vectors and maps as arrays and maps; a key that is there is not overwritten by an insert."""
    o = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("x"))
    v = F.transform("x", lambda e: e["l_suppkey"])
    o = o.select("l_orderkey", v.alias("v"))
    firsts = F.map_from_entries(F.transform(F.array_distinct(F.transform("v", lambda s: s % 3)), lambda k: F.struct(k, F.filter("v", lambda s: s % 3 == k)[0])))
    o = o.withColumn("m", firsts)
    inserted = F.map_concat("m", F.map_filter(F.create_map(F.lit(0).cast("long"), F.lit(-1).cast("long")), lambda k, _: ~F.map_contains_key("m", k)))
    return o.select("l_orderkey", F.size("v").alias("size"), F.array_join(F.array_append("v", F.lit(7).cast("long")), ",").alias("pushed"), F.array_join(F.reverse(F.slice("v", 1, 2)), ",").alias("head"), F.array_join(F.array_sort(F.array_distinct("v")), ",").alias("unique"), F.element_at(inserted, F.lit(0).cast("long")).alias("zero"), F.map_contains_key("m", F.lit(1).cast("long")).alias("has_one"), F.size(inserted).alias("n_keys"))


def chain_windows(spark, sf_dir):
    from ..operators.mapping import chain_window

    li = read(spark, sf_dir, "lineitem")
    b, e = chain_window(F.col("l_partkey"), F.col("l_quantity").cast("int"), F.lit(150), F.lit(1500).cast("long"), 32)
    return li.select("l_orderkey", "l_linenumber", b.alias("window_begin"), e.alias("window_end"))


def suffix_array(spark, sf_dir):
    """Suffix ranks of short contigs, the end before N before the bases."""
    s = reads(spark, sf_dir).select("read_id", F.concat(F.translate("seq", "NACGT", "12345"), F.lit("0")).alias("t"))
    each = s.select("read_id", "t", F.explode(F.sequence(F.lit(0), F.length("t") - 1)).alias("pos"))
    each = each.withColumn("suffix", F.expr("substring(t, pos + 1)"))
    rank = F.row_number().over(Window.partitionBy("read_id").orderBy("suffix")) - 1
    return each.select("read_id", "t", "pos", rank.alias("rank"))


def suffix_ranks(spark, sf_dir):
    return suffix_array(spark, sf_dir).select("read_id", "pos", "rank")


def bwt_rows(spark, sf_dir):
    """(read_id, rank, symbol): the last column of the sorted rotations."""
    s = suffix_array(spark, sf_dir)
    before = F.when(F.col("pos") == 0, F.lit("0")).otherwise(F.expr("substring(t, pos, 1)"))
    return s.select("read_id", "rank", F.translate(before, "012345", "$NACGT").alias("symbol"))


def bwt_text(spark, sf_dir):
    b = bwt_rows(spark, sf_dir).groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("rank", "symbol"))).alias("x"))
    return b.select("read_id", F.array_join(F.transform("x", lambda e: e["symbol"]), "").alias("bwt"))


def rank_table(spark, sf_dir):
    """Occurrences of the row's symbol up to each row."""
    w = Window.partitionBy("read_id", "symbol").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return bwt_rows(spark, sf_dir).select("read_id", "rank", "symbol", F.count("*").over(w).alias("occ"))


def symbol_starts(spark, sf_dir):
    """How many symbols of a contig sort before each symbol."""
    n = bwt_rows(spark, sf_dir).groupBy("read_id", "symbol").agg(F.count("*").alias("n"))
    order = F.instr(F.lit("$NACGT"), F.col("symbol"))
    w = Window.partitionBy("read_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return n.select("read_id", "symbol", "n", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start"))


def last_to_first(spark, sf_dir):
    """The row whose suffix begins one symbol earlier, from counts alone."""
    r, c = rank_table(spark, sf_dir), symbol_starts(spark, sf_dir)
    return r.join(c, ["read_id", "symbol"]).select("read_id", "rank", (F.col("start") + F.col("occ") - 1).alias("lf"))


def doubling_ranks(spark, sf_dir):
    """Dense ranks of all positions by their first eight symbols, made by doubling three times."""
    s = reads(spark, sf_dir).select("read_id", F.concat(F.translate("seq", "NACGT", "12345"), F.lit("0")).alias("t"))
    r = s.select("read_id", F.posexplode(F.split("t", "")).alias("pos", "c")).select("read_id", "pos", F.col("c").cast("int").alias("rank"))
    for step in (1, 2, 4):
        ahead = F.coalesce(F.lead("rank", step).over(Window.partitionBy("read_id").orderBy("pos")), F.lit(-1))
        r = r.withColumn("next", ahead)
        r = r.select("read_id", "pos", F.dense_rank().over(Window.partitionBy("read_id").orderBy("rank", "next")).alias("rank"))
    return r


SUFFIXES = f"""t AS (
  SELECT item_id AS read_id, translate({DNA}, 'NACGT', '12345') || '0' AS t FROM benchmark
), e AS (
  SELECT read_id, t, unnest(range(0, length(t))) AS pos FROM t
), sa AS (
  SELECT read_id, t, pos, row_number() OVER (PARTITION BY read_id ORDER BY substr(t, pos + 1)) - 1 AS rank FROM e
), bwt AS (
  SELECT read_id, rank, translate(CASE WHEN pos = 0 THEN '0' ELSE substr(t, pos, 1) END, '012345', '$NACGT') AS symbol FROM sa
)"""
ORDER_OPS = f"""o AS (
  SELECT l_orderkey, l_linenumber, l_partkey, substr('{S.OPS}', CAST(l_partkey % 9 + 1 AS BIGINT), 1) AS op, CAST(l_quantity AS INTEGER) AS len FROM lineitem
)"""
FLAG = "1 + (CASE WHEN l_partkey % 2 = 0 THEN 2 ELSE 0 END) + (CASE WHEN l_partkey % 7 = 0 THEN 4 ELSE 0 END) + (CASE WHEN l_suppkey % 5 = 0 THEN 8 ELSE 0 END) + (CASE WHEN l_returnflag = 'R' THEN 16 ELSE 0 END) + (CASE WHEN l_linestatus = 'O' THEN 32 ELSE 0 END) + (CASE WHEN l_linenumber = 1 THEN 64 ELSE 0 END) + (CASE WHEN l_linenumber = 2 THEN 128 ELSE 0 END) + (CASE WHEN l_orderkey % 11 = 0 THEN 256 ELSE 0 END) + (CASE WHEN l_orderkey % 6 = 0 THEN 2048 ELSE 0 END)"
POSITIONS = f"WITH {CONTIGS}, p AS (SELECT o_orderkey, (o_orderkey * 7919) % (SELECT sum(length) FROM contigs) AS position FROM orders)"

QUERIES = {
    f.__name__: f
    for f in (
        contig_table, total_length, added_contigs, encode_bases, reverse_complements, contig_md5, normalize_bases, locate_sequence, extract_ref, random_bases, cigar_pack, cigar_format, cigar_parse, cigar_spans, bins, mapping_quality, sam_flags, template_lengths,
        phred, byte_sizes, header_parts, fasta_lines, string_functions, container_functions, chain_windows, suffix_ranks, bwt_text, rank_table, symbol_starts, last_to_first, doubling_ranks,
    )
}

ORACLES = {
    "contig_table": f"WITH {CONTIGS} SELECT ref_id, name, length, \"offset\", md5 FROM contigs",
    "total_length": f"WITH {CONTIGS} SELECT CAST(sum(length) AS BIGINT) AS total_length, count(*) AS n_contigs FROM contigs",
    "added_contigs": f"""WITH {CONTIGS}, more AS (
  SELECT ref_id, name, seq FROM contigs UNION ALL SELECT 1000000000 + p_partkey, 'part' || p_partkey, {DNA.replace("text", "p_name")} FROM part
) SELECT ref_id, name, CAST(length(seq) AS BIGINT) AS length, CAST(coalesce(sum(length(seq)) OVER (ORDER BY ref_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset", md5(seq) AS md5 FROM more WHERE seq <> ''""",
    "encode_bases": f"SELECT item_id AS read_id, translate({DNA}, 'ACGTN', '01234') AS codes, {DNA} AS bases FROM benchmark",
    "reverse_complements": f"WITH {CONTIGS} SELECT ref_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM contigs",
    "contig_md5": f"WITH {CONTIGS} SELECT ref_id, md5 FROM contigs",
    "normalize_bases": "SELECT p_partkey, regexp_replace(upper(p_name), '[^ACGT]', 'N', 'g') AS seq FROM part",
    "locate_sequence": f"{POSITIONS} SELECT o_orderkey, CAST(position AS BIGINT) AS position, ref_id, CAST(position - \"offset\" AS BIGINT) AS local FROM p JOIN contigs ON position >= \"offset\" AND position < \"offset\" + length",
    "extract_ref": f"{POSITIONS} SELECT o_orderkey, CAST(position AS BIGINT) AS start, ref_id, substr(seq, CAST(position - \"offset\" + 1 AS BIGINT), 40) AS bases FROM p JOIN contigs ON position >= \"offset\" AND position < \"offset\" + length",
    "random_bases": """WITH e AS (
  SELECT id, i, CAST('0x' || substr(md5('42:' || id || ':' || i), 1, 7) AS BIGINT) AS v FROM range(50) a(id), range(200) b(i)
) SELECT id, string_agg(CASE WHEN (v // 4) % 1000000 < 10000 THEN 'N' ELSE substr('ACGT', v % 4 + 1, 1) END, '' ORDER BY i) AS seq FROM e GROUP BY id""",
    "cigar_pack": f"WITH {ORDER_OPS} SELECT l_orderkey, l_linenumber, CAST(len * 16 + l_partkey % 9 AS INTEGER) AS packed, len AS op_len, op FROM o",
    "cigar_format": f"WITH {ORDER_OPS} SELECT l_orderkey, string_agg(len || op, '' ORDER BY l_linenumber, l_partkey, len) AS cigar FROM o GROUP BY l_orderkey",
    "cigar_parse": f"WITH {ORDER_OPS} SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, len) - 1 AS INTEGER) AS i, op, len FROM o",
    "cigar_spans": f"""WITH {ORDER_OPS} SELECT l_orderkey, CAST(coalesce(sum(len) FILTER (op IN ('M', '=', 'X', 'D', 'N')), 0) AS INTEGER) AS ref_span, CAST(coalesce(sum(len) FILTER (op IN ('M', '=', 'X', 'I')), 0) AS INTEGER) AS query_span,
  CAST(coalesce(sum(len) FILTER (op IN ('X', 'I', 'D')), 0) AS INTEGER) AS nm, CAST(coalesce(sum(len) FILTER (op = 'X'), 0) AS INTEGER) AS n_mismatch, CAST(count(*) FILTER (op IN ('I', 'D')) AS INTEGER) AS n_gap_open, CAST(coalesce(sum(len) FILTER (op IN ('I', 'D')), 0) AS INTEGER) AS n_gap_base FROM o GROUP BY l_orderkey""",
    "bins": """WITH p AS (SELECT l_orderkey, l_linenumber, l_orderkey * 1009 AS b, l_orderkey * 1009 + CAST(trunc(l_quantity * l_quantity * 60) AS BIGINT) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN b >> 14 = e >> 14 THEN 4681 + (b >> 14) WHEN b >> 17 = e >> 17 THEN 585 + (b >> 17) WHEN b >> 20 = e >> 20 THEN 73 + (b >> 20) WHEN b >> 23 = e >> 23 THEN 9 + (b >> 23) WHEN b >> 26 = e >> 26 THEN 1 + (b >> 26) ELSE 0 END AS INTEGER) AS bin FROM p""",
    "mapping_quality": """WITH p AS (
  SELECT l_orderkey, l_linenumber, CAST(trunc(l_quantity * 3) AS INTEGER) AS score, CAST(l_partkey % 90 AS INTEGER) AS sub0, CAST(l_suppkey % 40 AS INTEGER) AS csub, l_linenumber - 1 AS sub_n FROM lineitem
), q AS (
  SELECT *, greatest(CASE WHEN sub0 <> 0 THEN sub0 ELSE 9 END, csub) AS rival, CAST(score + l_linenumber * 2 AS DOUBLE) AS size FROM p
), r AS (
  SELECT *, 1.0 - (size - score) / 5.0 / size AS identity FROM q
), s AS (
  SELECT *, (CASE WHEN size < 50 THEN 1.0::DOUBLE ELSE 3.912023005428146::DOUBLE / ln(size) END) * identity * identity AS weight FROM r
)
SELECT l_orderkey, l_linenumber, CAST(CASE WHEN rival >= score OR size <= 0 OR score = 0 THEN 0 ELSE greatest(0, least(60, trunc(6.02::DOUBLE * (score - rival) * weight * weight + 0.499::DOUBLE) - CASE WHEN sub_n > 0 THEN trunc(4.343::DOUBLE * ln(sub_n + 1.0::DOUBLE) + 0.499::DOUBLE) ELSE 0 END)) END AS INTEGER) AS mapq FROM s""",
    "sam_flags": f"WITH f AS (SELECT l_orderkey, l_linenumber, CAST({FLAG} AS INTEGER) AS flag FROM lineitem) SELECT l_orderkey, l_linenumber, flag, CAST(CASE WHEN flag & 2048 <> 0 THEN ((flag - 2048) | 256) ELSE flag END AS INTEGER) AS rewritten, flag & 16 <> 0 AS is_reverse FROM f",
    "template_lengths": """WITH p AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN l_partkey + CAST(l_quantity AS INTEGER) - 1 ELSE l_partkey END AS five, CASE WHEN l_linestatus = 'O' THEN l_suppkey * 20 + CAST(l_quantity AS INTEGER) - 1 ELSE l_suppkey * 20 END AS mate FROM lineitem)
SELECT l_orderkey, l_linenumber, five, CASE WHEN five <= mate THEN abs(five - mate) + 1 ELSE -(abs(five - mate) + 1) END AS tlen FROM p""",
    "phred": """WITH c AS (SELECT p_partkey, unnest(range(1, length(p_name) + 1)) AS i, p_name FROM part), v AS (SELECT p_partkey, i, greatest(unicode(substr(p_name, i, 1)) - 33, 0) AS v FROM c)
SELECT p_partkey, CAST(sum(v) AS INTEGER) AS total, string_agg(chr(CAST(least(v + 33, 126) AS INTEGER)), '' ORDER BY i) AS text FROM v GROUP BY p_partkey""",
    "byte_sizes": """WITH p AS (SELECT o_orderkey, CAST(trunc(o_totalprice * o_custkey) AS BIGINT) AS n FROM orders)
SELECT o_orderkey, CASE WHEN n >= 1099511627776 THEN printf('%.2f TB', n / 1099511627776.0::DOUBLE) WHEN n >= 1073741824 THEN printf('%.2f GB', n / 1073741824.0::DOUBLE) WHEN n >= 1048576 THEN printf('%.2f MB', n / 1048576.0::DOUBLE) WHEN n >= 1024 THEN printf('%.2f KB', n / 1024.0::DOUBLE) ELSE n || ' B' END AS size FROM p""",
    "header_parts": "SELECT doc_id, string_split(text, ' ')[1] AS name, CAST(CASE WHEN instr(text, ' ') > 0 THEN length(text) - instr(text, ' ') ELSE 0 END AS INTEGER) AS comment_length FROM documents",
    "fasta_lines": f"WITH {CONTIGS} SELECT ref_id, '>' || name || chr(10) || regexp_replace(seq, '(.{{1,80}})', '\\1' || chr(10), 'g') AS fasta FROM contigs",
    "string_functions": "SELECT c_custkey, c_name || '|' || c_nationkey AS joined, CAST(instr(c_name, '#') AS INTEGER) AS found, substr(c_name, 2, 5) AS part, rpad(c_mktsegment, 12, '_') AS padded, CAST(length(c_name) AS INTEGER) AS size, printf('%08d', c_custkey) AS number, c_name < c_mktsegment AS less FROM customer",
    "container_functions": """WITH o AS (SELECT l_orderkey, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS v FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CAST(len(v) AS INTEGER) AS size, array_to_string(list_append(v, 7), ',') AS pushed, array_to_string(list_reverse(v[1:2]), ',') AS head, array_to_string(list_sort(list_distinct(v)), ',') AS "unique",
  coalesce(list_filter(v, lambda x: x % 3 = 0)[1], -1) AS zero, len(list_filter(v, lambda x: x % 3 = 1)) > 0 AS has_one, CAST(len(list_distinct(list_append(list_transform(v, lambda x: x % 3), 0))) AS INTEGER) AS n_keys FROM o""",
    "chain_windows": "SELECT l_orderkey, l_linenumber, greatest(0, l_partkey - CAST(l_quantity AS INTEGER) - 16) AS window_begin, least(1500, l_partkey - CAST(l_quantity AS INTEGER) + 166) AS window_end FROM lineitem",
    "suffix_ranks": f"WITH {SUFFIXES} SELECT read_id, CAST(pos AS INTEGER) AS pos, CAST(rank AS INTEGER) AS rank FROM sa",
    "bwt_text": f"WITH {SUFFIXES} SELECT read_id, string_agg(symbol, '' ORDER BY rank) AS bwt FROM bwt GROUP BY read_id",
    "rank_table": f"WITH {SUFFIXES} SELECT read_id, CAST(rank AS INTEGER) AS rank, symbol, count(*) OVER (PARTITION BY read_id, symbol ORDER BY rank) AS occ FROM bwt",
    "symbol_starts": f"WITH {SUFFIXES}, n AS (SELECT read_id, symbol, count(*) AS n FROM bwt GROUP BY ALL) SELECT read_id, symbol, n, CAST(coalesce(sum(n) OVER (PARTITION BY read_id ORDER BY instr('$NACGT', symbol) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM n",
    "last_to_first": f"WITH {SUFFIXES} SELECT b.read_id, CAST(b.rank AS INTEGER) AS rank, CAST(a2.rank AS BIGINT) AS lf FROM sa b JOIN sa a2 ON a2.read_id = b.read_id AND a2.pos = CASE WHEN b.pos = 0 THEN length(b.t) - 1 ELSE b.pos - 1 END",
    "doubling_ranks": f"WITH {SUFFIXES} SELECT read_id, CAST(pos AS INTEGER) AS pos, CAST(dense_rank() OVER (PARTITION BY read_id ORDER BY substr(t, pos + 1, 8)) AS INTEGER) AS rank FROM sa",
}
