"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints of 64 bits are cut into six blocks.  Two that differ in at most three
bits agree in at least three blocks, so each choice of three blocks is a join key of
about 32 bits: selective enough that chance collisions stay far below one per row at
billions of rows, where one block of 16 bits would not be.  Collisions are verified by
Hamming distance and clustered.

Rows: every document gets a fingerprint.  A null text counts as empty, and a text
without words has fingerprint zero, which links like any other.  Equal fingerprints are
one node, so copies cost nothing.  A null doc_id takes part, and its component is named
by the smallest doc_id that is not null, or null.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import as_row, row_column, stage, unpacked, whole_text
from .components import components
from .forest import bucket_links

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
PIECE = 1 << 16


def fingerprint(text: str, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else [words]
    h = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, grams), repeat(42)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, PIECE):
        bits = np.unpackbits(h[at : at + PIECE].astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id long, fp long)``, the bits as a signed long."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(x, shingle) for x in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, "doc_id long, fp long")


def block_masks(distance: int = 3, blocks: int = 6) -> list[int]:
    """Masks, as signed longs, of each choice of ``blocks - distance`` blocks."""
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(ends, ends[1:])]
    masks = [sum(x) for x in combinations(part, blocks - distance)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(nodes: DataFrame, distance: int = 3, blocks: int = 6) -> DataFrame:
    """``nodes(fp)``, distinct, to verified links ``(u, v)`` that connect all within the distance."""
    masks = block_masks(distance, blocks)
    keys = F.array(*(F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)))
    members = nodes.select(F.explode(keys).alias("bucket"), F.col("fp").alias("id"))

    def near(t: pa.Table) -> np.ndarray:
        x = t["id"].to_numpy().view(np.uint64)
        return np.bitwise_count(x[:, None] ^ x[None, :]) <= distance

    return bucket_links(members, near)


def simhash_groups(docs: DataFrame, shingle: int = 3, distance: int = 3, blocks: int = 6) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, fp, component_id)``, a row per input row."""
    fps = stage(fingerprints(docs, shingle), "fingerprints")
    nodes = stage(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    comp = components(links(nodes.select("fp"), distance, blocks))
    named = nodes.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    roots = named.groupBy("label").agg(F.min("first").alias("component_id"))
    fp_root = stage(named.join(roots, "label").select("fp", "component_id"), "roots")
    return fps.join(fp_root, "fp").select("doc_id", "fp", "component_id")


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """One document of each group stays: the one with the smallest (doc_id, text).

    Of rows that repeat a kept row exactly, one stays.  A null doc_id sorts first.
    """
    rows = numbered(docs)
    group = simhash_groups(rows.select(F.col("number_").alias("doc_id"), row_column("text").alias("text")), **how)
    return first_of_each(rows, group.select(F.col("doc_id").alias("number_"), F.col("component_id").alias("group_")), docs.columns)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` as ``row_`` with a number for each row, written so that the numbers stay."""
    return stage(as_row(docs, number_=F.monotonically_increasing_id()), "rows")


def first_of_each(rows: DataFrame, group: DataFrame, names: list[str]) -> DataFrame:
    """Of ``rows`` the first one of each ``group(number_, group_)``."""
    order = F.struct(row_column("doc_id").alias("a"), F.xxhash64(row_column("text")).alias("b"), F.col("number_").alias("c"))
    keep = rows.select("number_", order.alias("o")).join(group, "number_").groupBy("group_").agg(F.min("o")["c"].alias("number_"))
    return unpacked(rows.join(keep.select("number_"), "number_", "left_semi"), names)
