"""Intermediate tables in the shared folder that ``spark.checkpoint.dir`` names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_roots: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The shared folder; a temporary one where the setting is unset and all runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="strandline-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """A new path below a folder of the application, which goes when the application ends."""
    key = (spark.sparkContext.applicationId, shared_folder(spark))
    if key not in _roots:
        _roots[key] = f"{key[1]}/strandline/{uuid.uuid4().hex}"
        at = spark._jvm.org.apache.hadoop.fs.Path(_roots[key])
        files = at.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{_roots[key]}/{uuid.uuid4().hex}"


def written(df: DataFrame, path: str, mode: str = "errorifexists", **options) -> None:
    """Write ``df`` compressed well; the shuffle files of the write go as soon as it has ended."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode(mode).options(compression="zstd", **options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` once and read it back, so that later jobs do not compute it again."""
    spark = df.sparkSession
    path = own_folder(spark)
    written(df, path)
    return spark.read.schema(df.schema).parquet(path)
