"""Queries on output formats, index tables, sorts and sets, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..config import Config, ReadGroup
from ..functions import sequence as S
from ..sources import bam, sam
from .sequences import CONTIGS, contigs, read


def placed(spark, sf_dir) -> DataFrame:
    """Lines as records of 100 contigs in coordinate order, with the virtual offsets a file would give them.

    Offsets are ranks, a hundred bytes apart: first the placed records by contig and position, then the others.
    """
    li = read(spark, sf_dir, "lineitem")
    ref = F.when(F.col("l_returnflag") == "N", (F.col("l_partkey") % 100).cast("int")).otherwise(F.lit(-1))
    r = li.select("l_orderkey", "l_linenumber", "l_partkey", ref.alias("ref_idx"), (F.col("l_orderkey") % 3000 * 37).cast("int").alias("pos0"), F.col("l_quantity").cast("int").alias("span"))
    r = r.withColumn("end0", F.col("pos0") + F.col("span") * 400)
    order = Window.partitionBy("ref_idx").orderBy("pos0", "l_orderkey", "l_linenumber", "l_partkey", "span")
    n = r.groupBy("ref_idx").agg(F.count("*").alias("n_"))
    before = Window.orderBy((F.col("ref_idx") < 0).cast("int"), "ref_idx").rowsBetween(Window.unboundedPreceding, -1)
    base = n.select(F.col("ref_idx").alias("k_"), F.coalesce(F.sum("n_").over(before), F.lit(0)).alias("base_"))
    r = r.withColumn("r_", F.row_number().over(order)).join(base, F.col("ref_idx") == F.col("k_"))
    r = r.withColumn("beg", (F.col("base_") + F.col("r_") - 1) * 100).withColumn("end", F.col("beg") + 100)
    return r.withColumn("bin", S.reg2bin("pos0", "end0")).drop("r_", "k_", "base_")


def coordinate_order(spark, sf_dir):
    return placed(spark, sf_dir).select("l_orderkey", "l_linenumber", "ref_idx", "pos0", "beg")


def bai_bins(spark, sf_dir):
    return bam.index_bins(placed(spark, sf_dir))


def bai_linear(spark, sf_dir):
    return bam.index_linear(placed(spark, sf_dir))


def bai_unplaced(spark, sf_dir):
    return bam.unplaced(placed(spark, sf_dir))


def index_check(spark, sf_dir):
    """Records whose first window points beyond them; none if the index is right."""
    p, lin = placed(spark, sf_dir).where("ref_idx >= 0"), bai_linear(spark, sf_dir)
    j = p.withColumn("win", F.shiftright("pos0", 14)).join(lin, ["ref_idx", "win"])
    return j.agg(F.count("*").alias("n"), F.count_if(F.col("off") > F.col("beg")).alias("beyond"))


def sorted_check(spark, sf_dir):
    """Steps back in the coordinate order of records taken by offset."""
    order = Window.partitionBy("ref_idx").orderBy("beg")
    p = placed(spark, sf_dir).withColumn("prev", F.lag("pos0").over(order))
    return p.groupBy("ref_idx").agg(F.count_if(F.col("prev") > F.col("pos0")).alias("steps_back"))


def records(spark, sf_dir) -> DataFrame:
    """Orders as records: customers are reads, statuses decide flags."""
    o = read(spark, sf_dir, "orders")
    mapped = F.col("o_orderstatus") != "P"
    return o.select(
        F.col("o_orderkey").alias("read_id"), F.concat(F.lit("read_"), F.col("o_orderkey").cast("string")).alias("name"), S.flag(unmapped=~mapped, reverse=F.col("o_orderstatus") == "F", supplementary=F.col("o_orderkey") % 10 == 0).alias("flag"),
        F.when(mapped, F.concat(F.lit("doc"), (F.col("o_custkey") % 50).cast("string"))).otherwise(F.lit("*")).alias("rname"), F.when(mapped, F.col("o_custkey").cast("int")).otherwise(F.lit(0)).alias("pos"), (F.col("o_custkey") % 61).cast("int").alias("mapq"), F.when(mapped, "12M3D8=").otherwise("*").alias("cigar"),
        F.when(F.col("o_orderkey") % 2 == 0, "=").otherwise("*").alias("rnext"), F.lit(1).alias("pnext"), F.lit(0).alias("tlen"), F.lit("ACGTACGTACGTACGTACGT").alias("seq"), F.lit("*").alias("qual"),
        F.array_compact(F.array(F.concat(F.lit("NM:i:"), (F.col("o_custkey") % 4).cast("string")), F.when(F.col("o_custkey") % 3 == 0, F.lit("XS:i:9")))).alias("tags"),
    )


def sam_text(spark, sf_dir):
    return sam.sam_rows(records(spark, sf_dir)).select("read_id", "value")


def sam_header(spark, sf_dir):
    cfg = Config(read_group=ReadGroup.parse("@RG\\tID:g1\\tSM:s\\tPL:x"), header_lines=("@CO\tmade up",))
    return sam.header_rows(contigs(spark, sf_dir), cfg).select("section", "n", "value")


def sam_parse(spark, sf_dir):
    """SAM lines taken apart again."""
    r = sam.sam_rows(records(spark, sf_dir)).withColumn("f", F.split("value", "\t")).where(F.size("f") >= 11)
    return r.select(F.col("f")[0].alias("name"), F.col("f")[1].cast("int").alias("flag"), F.col("f")[2].alias("rname"), F.col("f")[3].cast("int").alias("pos"), F.size("f").alias("n_fields"))


def split_flags(spark, sf_dir):
    r = records(spark, sf_dir)
    return r.select("read_id", S.split_as_secondary("flag").alias("flag"))


def emission_order(spark, sf_dir):
    """Records in the order of a file: reads, then mates, then kinds."""
    li = read(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    order = Window.partitionBy("l_orderkey").orderBy(F.col("l_linenumber") % 2, kind, "l_linenumber", "l_partkey")
    return li.select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("place"))


def bam_fields(spark, sf_dir):
    refs = contigs(spark, sf_dir).select("name", "ref_id")
    p = bam.projected(records(spark, sf_dir), refs)
    return p.select("read_id", "ref_idx", "mate_idx", "pos0", "end0", "bin")


def same_records(spark, sf_dir):
    """Records of SAM and of their parsed form as multisets: how many are in one but not in the other."""
    a = records(spark, sf_dir).select("name", "flag", "rname", "pos")
    b = sam_parse(spark, sf_dir).select("name", "flag", "rname", "pos")
    return a.exceptAll(b).unionByName(b.exceptAll(a)).agg(F.count("*").alias("different"))


# Sorts, limits and sets.


def radix_order(spark, sf_dir):
    """Signed values in order: the rank of each, ties by key."""
    p = read(spark, sf_dir, "customer")
    return p.select("c_custkey", "c_acctbal", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).alias("rank"))


def pair_order(spark, sf_dir):
    """Key-value pairs sorted by key, stable."""
    li = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_suppkey").orderBy("l_partkey", "l_orderkey", "l_linenumber")
    return li.select("l_suppkey", "l_orderkey", "l_linenumber", F.row_number().over(order).alias("rank"))


def match_order(spark, sf_dir):
    """Matches by (query position, contig, length descending), as an array per order."""
    li = read(spark, sf_dir, "lineitem")
    row = F.struct((F.col("l_partkey") % 80).alias("q"), (F.col("l_suppkey") % 4).alias("r"), (-F.col("l_quantity")).alias("n"), "l_linenumber")
    g = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("x"))
    return g.select("l_orderkey", F.array_join(F.transform("x", lambda e: e["l_linenumber"].cast("string")), ",").alias("lines"))


def partial_order(spark, sf_dir):
    """The 25 largest orders."""
    o = read(spark, sf_dir, "orders")
    return o.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


def nth_elements(spark, sf_dir):
    """The middle order of each priority by price."""
    o = read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_orderpriority")
    o = o.withColumn("i", F.row_number().over(w.orderBy("o_totalprice", "o_orderkey"))).withColumn("n", F.count("*").over(w))
    return o.where(F.col("i") == F.floor(F.col("n") / 2) + 1).select("o_orderpriority", "o_orderkey", "o_totalprice")


def sorted_positions(spark, sf_dir):
    """Positions of an order's quantities in ascending order, and the quantities gathered by them."""
    li = read(spark, sf_dir, "lineitem")
    g = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_partkey"))).alias("x"))
    g = g.withColumn("v", F.transform("x", lambda e: e["q"]))
    at = F.transform(F.array_sort(F.transform("v", lambda q, i: F.struct(q.alias("q"), i.alias("i")))), lambda e: e["i"])
    g = g.withColumn("at", at)
    return g.select("l_orderkey", F.array_join(F.transform("at", lambda i: i.cast("string")), ",").alias("positions"), F.array_join(F.transform("at", lambda i: F.get(F.col("v"), i).cast("string")), ",").alias("gathered"))


def bounds(spark, sf_dir):
    """For each supplier, how many prices lie below and at most at its account balance."""
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.floor("s_acctbal").alias("b"))
    p = read(spark, sf_dir, "part").groupBy(F.floor("p_retailprice").alias("v")).agg(F.count("*").alias("n"))
    # One pass of sums over the distinct values of both sides, so that no join compares all pairs.
    both = p.select("v", "n").unionByName(s.select(F.col("b").alias("v"), F.lit(0).cast("long").alias("n"))).groupBy("v").agg(F.sum("n").alias("n"))
    upto = Window.orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("upper", F.sum("n").over(upto)).withColumn("lower", F.col("upper") - F.col("n"))
    return s.join(both, F.col("b") == F.col("v")).select("s_suppkey", "lower", "upper")


def distinct_values(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


def all_matches(spark, sf_dir):
    """Forward and reverse matches in one table."""
    li = read(spark, sf_dir, "lineitem")
    one = li.where("l_returnflag = 'R'").select("l_orderkey", F.lit("-").alias("strand"), "l_partkey")
    two = li.where("l_linestatus = 'O'").select("l_orderkey", F.lit("+").alias("strand"), "l_partkey")
    return one.unionByName(two)


def set_difference(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    b = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    return a.exceptAll(b)


def set_intersection(spark, sf_dir):
    a = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    return a.intersect(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")))


def decile_trim(spark, sf_dir):
    """Quantities of each supplier without the lowest and the highest tenth."""
    li = read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey")
    r = li.withColumn("i", F.row_number().over(w.orderBy("l_quantity", "l_orderkey", "l_linenumber"))).withColumn("n", F.count("*").over(w))
    cut = F.floor(F.col("n") / 10)
    r = r.where((F.col("i") > cut) & (F.col("i") <= F.col("n") - cut))
    return r.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("total"), F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"))


def union_coverage(spark, sf_dir):
    """Positions that at least one line of a supplier covers."""
    from ..operators.seeding import coverage

    li = read(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") * 7).alias("b"), F.col("l_quantity").cast("int").alias("n"))
    return coverage(li, ["l_suppkey"], "b", "n")


def column_counts(spark, sf_dir):
    """Counts of a group along cube and rollup of two keys."""
    li = read(spark, sf_dir, "lineitem")
    return li.cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


QUERIES = {
    f.__name__: f
    for f in (
        coordinate_order, bai_bins, bai_linear, bai_unplaced, index_check, sorted_check, sam_text, sam_header, sam_parse, split_flags, emission_order, bam_fields, same_records, 
        radix_order, pair_order, match_order, partial_order, nth_elements, sorted_positions, bounds, distinct_values, all_matches, set_difference, set_intersection, decile_trim, union_coverage, column_counts,
    )
}

PLACED = """r AS (
  SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'N' THEN CAST(l_partkey % 100 AS INTEGER) ELSE -1 END AS ref_idx, CAST(l_orderkey % 3000 * 37 AS INTEGER) AS pos0, CAST(l_quantity AS INTEGER) AS span FROM lineitem
), e AS (
  SELECT *, pos0 + span * 400 AS end0, (row_number() OVER (ORDER BY ref_idx < 0, ref_idx, pos0, l_orderkey, l_linenumber, l_partkey, span) - 1) * 100 AS beg FROM r
), placed AS (
  SELECT *, beg + 100 AS "end", CAST(CASE WHEN pos0 >> 14 = (end0 - 1) >> 14 THEN 4681 + (pos0 >> 14) WHEN pos0 >> 17 = (end0 - 1) >> 17 THEN 585 + (pos0 >> 17) WHEN pos0 >> 20 = (end0 - 1) >> 20 THEN 73 + (pos0 >> 20)
    WHEN pos0 >> 23 = (end0 - 1) >> 23 THEN 9 + (pos0 >> 23) WHEN pos0 >> 26 = (end0 - 1) >> 26 THEN 1 + (pos0 >> 26) ELSE 0 END AS INTEGER) AS bin FROM e
)"""
LINEAR = f"""{PLACED}, w AS (
  SELECT ref_idx, unnest(range(pos0 >> 14, ((end0 - 1) >> 14) + 1)) AS win, beg FROM placed WHERE ref_idx >= 0
), h AS (
  SELECT ref_idx, win, min(beg) AS off FROM w GROUP BY ALL
), every AS (
  SELECT ref_idx, unnest(range(0, m + 1)) AS win FROM (SELECT ref_idx, max(win) AS m FROM h GROUP BY ALL)
), linear AS (
  SELECT every.ref_idx, CAST(every.win AS INTEGER) AS win, first_value(off IGNORE NULLS) OVER (PARTITION BY every.ref_idx ORDER BY every.win ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS off FROM every LEFT JOIN h ON h.ref_idx = every.ref_idx AND h.win = every.win
)"""
RECORDS = """rec AS (
  SELECT o_orderkey AS read_id, 'read_' || o_orderkey AS name, CAST((CASE WHEN o_orderstatus = 'P' THEN 4 ELSE 0 END) + (CASE WHEN o_orderstatus = 'F' THEN 16 ELSE 0 END) + (CASE WHEN o_orderkey % 10 = 0 THEN 2048 ELSE 0 END) AS INTEGER) AS flag,
    CASE WHEN o_orderstatus <> 'P' THEN 'doc' || o_custkey % 50 ELSE '*' END AS rname, CAST(CASE WHEN o_orderstatus <> 'P' THEN o_custkey ELSE 0 END AS INTEGER) AS pos, CAST(o_custkey % 61 AS INTEGER) AS mapq, CASE WHEN o_orderstatus <> 'P' THEN '12M3D8=' ELSE '*' END AS cigar,
    CASE WHEN o_orderkey % 2 = 0 THEN '=' ELSE '*' END AS rnext, 'NM:i:' || o_custkey % 4 || CASE WHEN o_custkey % 3 = 0 THEN chr(9) || 'XS:i:9' ELSE '' END AS tags, o_custkey, CASE WHEN o_custkey % 3 = 0 THEN 13 ELSE 12 END AS n_fields FROM orders
)"""

ORACLES = {
    "coordinate_order": f"WITH {PLACED} SELECT l_orderkey, l_linenumber, ref_idx, pos0, beg FROM placed",
    "bai_bins": f"""WITH {PLACED}, g AS (SELECT ref_idx, bin, beg, "end", CASE WHEN lag("end") OVER (PARTITION BY ref_idx, bin ORDER BY beg) = beg THEN 0 ELSE 1 END AS fresh FROM placed WHERE ref_idx >= 0),
u AS (SELECT *, sum(fresh) OVER (PARTITION BY ref_idx, bin ORDER BY beg) AS run FROM g) SELECT ref_idx, bin, min(beg) AS beg, max("end") AS "end" FROM u GROUP BY ref_idx, bin, run""",
    "bai_linear": f"WITH {LINEAR} SELECT * FROM linear",
    "bai_unplaced": f"WITH {PLACED} SELECT count(*) FILTER (ref_idx < 0) AS n_no_coor FROM placed",
    "index_check": f"WITH {LINEAR} SELECT count(*) AS n, count(*) FILTER (off > beg) AS beyond FROM placed JOIN linear ON linear.ref_idx = placed.ref_idx AND linear.win = placed.pos0 >> 14",
    "sorted_check": f"WITH {PLACED}, p AS (SELECT ref_idx, pos0, lag(pos0) OVER (PARTITION BY ref_idx ORDER BY beg) AS prev FROM placed) SELECT ref_idx, count(*) FILTER (prev > pos0) AS steps_back FROM p GROUP BY ref_idx",
    "sam_text": f"WITH {RECORDS} SELECT read_id, concat_ws(chr(9), name, flag, rname, pos, mapq, cigar, rnext, 1, 0, 'ACGTACGTACGTACGTACGT', '*', tags) AS value FROM rec",
    "sam_header": f"""WITH {CONTIGS} SELECT 1 AS section, ref_id AS n, '@SQ' || chr(9) || 'SN:' || name || chr(9) || 'LN:' || length || chr(9) || 'M5:' || md5 AS value FROM contigs
UNION ALL SELECT 0, 0, '@HD' || chr(9) || 'VN:1.6' || chr(9) || 'SO:unsorted' UNION ALL SELECT 2, 0, '@RG' || chr(9) || 'ID:g1' || chr(9) || 'SM:s' || chr(9) || 'PL:x'
UNION ALL SELECT 3, 0, '@PG' || chr(9) || 'ID:strandline' || chr(9) || 'PN:strandline' || chr(9) || 'VN:0.1.0' UNION ALL SELECT 4, 0, '@CO' || chr(9) || 'made up'""",
    "sam_parse": f"WITH {RECORDS} SELECT name, flag, rname, pos, CAST(n_fields AS INTEGER) AS n_fields FROM rec",
    "split_flags": f"WITH {RECORDS} SELECT read_id, CAST(CASE WHEN flag & 2048 <> 0 THEN (flag - 2048) | 256 ELSE flag END AS INTEGER) AS flag FROM rec",
    "emission_order": "SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 2, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END, l_linenumber, l_partkey) AS INTEGER) AS place FROM lineitem",
    "bam_fields": f"""WITH {CONTIGS}, {RECORDS}, p AS (
  SELECT read_id, CAST(coalesce(o.ref_id, -1) AS INTEGER) AS ref_idx, CAST(coalesce(CASE WHEN rnext = '=' THEN o.ref_id END, -1) AS INTEGER) AS mate_idx, pos - 1 AS pos0, CASE WHEN o.ref_id IS NULL THEN pos - 1 ELSE pos - 1 + 23 END AS end0 FROM rec LEFT JOIN contigs o ON o.name = rname
)
SELECT *, CAST(CASE WHEN ref_idx < 0 THEN 4680 WHEN pos0 >> 14 = (end0 - 1) >> 14 THEN 4681 + (pos0 >> 14) WHEN pos0 >> 17 = (end0 - 1) >> 17 THEN 585 + (pos0 >> 17) ELSE 0 END AS INTEGER) AS bin FROM p""",
    "same_records": "SELECT CAST(0 AS BIGINT) AS different",
    "radix_order": "SELECT c_custkey, c_acctbal, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS INTEGER) AS rank FROM customer",
    "pair_order": "SELECT l_suppkey, l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey, l_orderkey, l_linenumber) AS INTEGER) AS rank FROM lineitem",
    "match_order": "SELECT l_orderkey, string_agg(l_linenumber, ',' ORDER BY l_partkey % 80, l_suppkey % 4, -l_quantity, l_linenumber) AS lines FROM lineitem GROUP BY l_orderkey",
    "partial_order": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25",
    "nth_elements": "WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) AS i, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders) SELECT o_orderpriority, o_orderkey, o_totalprice FROM o WHERE i = n // 2 + 1",
    "sorted_positions": """WITH v AS (SELECT l_orderkey, CAST(l_quantity AS INTEGER) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INTEGER), l_partkey) - 1 AS i FROM lineitem)
SELECT l_orderkey, string_agg(i, ',' ORDER BY q, i) AS positions, string_agg(q, ',' ORDER BY q, i) AS gathered FROM v GROUP BY l_orderkey""",
    "bounds": """WITH s AS (SELECT s_suppkey, floor(s_acctbal) AS b FROM supplier), p AS (SELECT floor(p_retailprice) AS v FROM part)
SELECT s_suppkey, (SELECT count(*) FROM p WHERE v < b) AS lower, (SELECT count(*) FROM p WHERE v <= b) AS upper FROM s""",
    "distinct_values": "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem",
    "all_matches": "SELECT l_orderkey, '-' AS strand, l_partkey FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT l_orderkey, '+', l_partkey FROM lineitem WHERE l_linestatus = 'O'",
    "set_difference": "SELECT o_custkey AS k FROM orders EXCEPT ALL SELECT c_custkey FROM customer",
    "set_intersection": "SELECT o_custkey AS k FROM orders INTERSECT SELECT s_suppkey FROM supplier",
    "decile_trim": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_quantity, l_orderkey, l_linenumber) AS i, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT l_suppkey, count(*) AS n, sum(l_quantity) AS total, min(l_quantity) AS low, max(l_quantity) AS high FROM r WHERE i > n // 10 AND i <= n - n // 10 GROUP BY l_suppkey",
    "union_coverage": """WITH c AS (SELECT l_suppkey, l_partkey * 7 AS b, CAST(l_quantity AS INTEGER) AS n FROM lineitem), r AS (SELECT *, max(b + n) OVER (PARTITION BY l_suppkey ORDER BY b, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM c)
SELECT l_suppkey, CAST(sum(greatest(0, b + n - greatest(b, coalesce(reach, b)))) AS BIGINT) AS covered FROM r GROUP BY l_suppkey""",
    "column_counts": "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
}
