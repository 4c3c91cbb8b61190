"""A corpus pipeline of five operators: quality, lines, near-duplicates, mixing, packing.

Each stage gets what the one before it kept, as a Parquet table, and returns a DataFrame; all but the last return the
columns of ``documents``.  Nulls, empty texts, repeated rows and empty tables are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import linejoin, mixing, nearcopies, packing, quality
from strandline.llm.common import discard, stage, table
from strandline.llm.queries import tokenizer_ranks


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.accepted(docs, model, 0.3)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line repeats within a few edits, or exactly if they are short."""
    return linejoin.drop_repeated_lines(docs, shortest=linejoin.SHORTEST)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles with a Jaccard similarity of at least 0.8."""
    return nearcopies.near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in training sequences."""
    return packing.packed(docs, tokenizer_ranks())


STAGES = [
    ("quality", keep_quality),
    ("lines", drop_lines),
    ("near_copies", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenization and hashing cannot be written in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        before, docs = docs, stage(step(spark, docs, sf_dir), f"pipeline_{name}")
        discard(before)  # what a stage kept is written; nothing reads its input again
    return STAGES[-1][1](spark, docs, sf_dir)
