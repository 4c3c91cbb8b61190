"""Reads that arrive as files, mapped batch by batch with Structured Streaming.

Mapping a read needs no other read, so there is no state beside the source's own progress.  Each micro-batch goes through
the batch plan and is written under its batch number, so that a batch that is replayed replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators.index import Reference, reference
from ..operators.mapping import align_single

READS = "read_id long, name string, seq string, qual string"


def align_stream(spark: SparkSession, source: str, refs: DataFrame | Reference, sink: str, state: str, cfg: Config = Config(), files: int = 16) -> StreamingQuery:
    """Map the Parquet files of reads in ``source`` that are not yet mapped into ``sink``, ``files`` at a time."""

    def batch(rows: DataFrame, number: int) -> None:
        align_single(rows, of, cfg).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    of = reference(refs, keep=True)  # once, not for each batch
    reads = spark.readStream.schema(READS).option("maxFilesPerTrigger", files).parquet(source)
    return reads.writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
