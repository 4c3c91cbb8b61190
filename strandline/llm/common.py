"""Shared helpers: staged tables in the shared folder and row-safe columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Bytes that separate words, as a Java character class and as Python's bytes.split() sees them.
WORD = r"[^\x20\x09-\x0D]+"
BLOOM = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_roots: dict[tuple[str, str], str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; a temporary one where that is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def file_system(spark: SparkSession, path: str):
    """Hadoop's path and file system of ``path``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below a folder of the application, which goes when the application ends."""
    key = (spark.sparkContext.applicationId, shared_dir(spark))
    if key not in _roots:
        _roots[key] = f"{key[1]}/strandline/{uuid.uuid4().hex}"
        at, files = file_system(spark, _roots[key])
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{_roots[key]}/{uuid.uuid4().hex}/{name}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage, survives lost executors, and lets Spark delete the shuffle
    files of the write as soon as it has ended.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def discard(*staged: DataFrame) -> None:
    """Remove tables that ``stage`` wrote and that nothing will read again."""
    for df in staged:
        if path := getattr(df, "staged_at", None):
            at, files = file_system(df.sparkSession, path)
            files.delete(at, True)


def column(name: str) -> Column:
    """The column of that very name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_row(docs: DataFrame, **more: Column) -> DataFrame:
    """``docs`` as one struct ``row_`` beside the columns in ``more``, so that no name of theirs can clash."""
    return docs.select(F.struct(*map(column, docs.columns)).alias("row_"), *(v.alias(k) for k, v in more.items()))


def row_column(name: str) -> Column:
    return F.col("row_")[name]


def unpacked(rows: DataFrame, names: list[str], **new: Column) -> DataFrame:
    """The columns that ``as_row`` put away, those in ``new`` replaced."""
    return rows.select(*(new.get(c, row_column(c)).alias(c) for c in names))


def whole_text(name: str = "text") -> Column:
    """The text of a row; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, condition) -> DataFrame:
    """``df.where(condition)``, but never pushed below.

    A filter on a computed column is moved towards the scan with all that it is computed from
    written out again and again; rows are dropped here by an explode instead, which stays in place.
    """
    mark = f"kept_{uuid.uuid4().hex}"
    return df.withColumn(mark, F.explode(F.when(condition, F.array(F.lit(True))))).drop(mark)
