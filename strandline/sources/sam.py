"""SAM text: header, rows in emission order, and a reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import Config

COLUMNS = ["name", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual"]


def header_rows(refs: DataFrame, cfg: Config = Config(), order: str = "unsorted") -> DataFrame:
    """(section, n, value): header lines, to be ordered by (section, n)."""
    spark = refs.sparkSession
    fixed = [(0, 0, f"@HD\tVN:1.6\tSO:{order}")]
    if g := cfg.read_group:
        parts = [("ID", g.id), ("SM", g.sample), ("LB", g.library), ("PL", g.platform), ("PU", g.unit)]
        fixed.append((2, 0, "@RG\t" + "\t".join(f"{k}:{v}" for k, v in parts if v)))
    fixed.append((3, 0, f"@PG\tID:{cfg.program[0]}\tPN:{cfg.program[0]}\tVN:{cfg.program[1]}"))
    fixed += [(4, i, x) for i, x in enumerate(cfg.header_lines)]
    rest = spark.createDataFrame(fixed, "section int, n long, value string")
    line = F.concat(F.lit("@SQ\tSN:"), F.col("name"), F.lit("\tLN:"), F.col("length").cast("string"), F.lit("\tM5:"), F.col("md5"))
    return rest.unionByName(refs.select(F.lit(1).alias("section"), F.col("ref_id").cast("long").alias("n"), line.alias("value")))


def sam_rows(records: DataFrame) -> DataFrame:
    """``records`` with ``value``, the SAM line; ``tags`` is an array of whole tags."""
    fixed = [F.coalesce(F.col(c).cast("string"), F.lit("*")) for c in COLUMNS]
    return records.withColumn("value", F.concat_ws("\t", *fixed, F.col("tags")))


def write_sam(records: DataFrame, refs: DataFrame, path: str, cfg: Config = Config(), gzip: bool = False) -> None:
    """Part files whose names sort in emission order: the header, then reads in order, each read's records by kind."""
    keys = [c for c in ("pair_id", "read_id", "mate", "kind_ord", "idx") if c in records.columns]
    body = sam_rows(records).select(F.lit(9).alias("section"), *keys, "value")
    head = header_rows(refs, cfg)
    for k in keys:
        head = head.withColumn(k, F.col("n").cast(records.schema[k].dataType))
    rows = head.drop("n").unionByName(body).repartitionByRange("section", *keys).sortWithinPartitions("section", *keys)
    out = rows.select("value").write.mode("overwrite")
    (out.option("compression", "gzip") if gzip else out).text(path)


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Records of SAM text; header lines and lines of fewer than eleven fields are skipped."""
    raw = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    raw = raw.where(~F.startswith("value", F.lit("@"))).withColumn("f", parts).where(F.size("f") >= 11)
    numbers = {"flag", "pos", "mapq", "pnext", "tlen"}
    cols = [(F.col("f")[i].cast("int") if c in numbers else F.col("f")[i]).alias(c) for i, c in enumerate(COLUMNS)]
    return raw.select("line_no", *cols, F.slice("f", 12, F.size("f")).alias("tags"))
