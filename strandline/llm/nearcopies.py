"""Near copies of whole texts: wide SimHash fingerprints in blocks, Hamming distance, then exact Jaccard similarity.

Two texts are near copies if the sets of their five-word shingles have a Jaccard similarity of at least 0.8.  As in
``simhash``, a bit of a fingerprint is 1 if it is set in over half of the hashes of the shingles; texts meet where a block of their
fingerprints is equal, and are kept apart by Hamming distance.  64 bits and 3 of them, which suit copies that are all but
equal, miss most pairs at 0.8: such a pair differs in about 15 % of the bits.  So a fingerprint has 1,024 bits in 64 blocks
of 16, of which a pair at 0.8 shares one with a probability of 0.99 (at 0.85: 0.999), and the radius is 31 of the first
128 bits, within which it lies with 0.998.  Texts that are linked so form groups, in which all are compared by their whole sets.  Groups of
near copies are the connected components of what that confirms.

Rows: a null text counts as empty.  Texts without words are alike, and a text of fewer than five words is one shingle.
Texts with equal sets are one node, so copies cost nothing.  An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import row_column, stage, whole_text
from .components import components
from .forest import bucket_links
from .paragraphs import Words, alike, blend
from .simhash import first_of_each, numbered

SHINGLE, SIMILARITY = 5, 0.8
#: Blocks of a fingerprint and their bits; how many of the first 128 bits of two near copies may differ.
BLOCKS, BITS, RADIUS = 64, 16, 31
#: Shingles whose bits are counted at a time: the counts fit a byte.
PIECE = 255
_rng = np.random.default_rng(9)
SCALE = _rng.integers(1, 1 << 63, BLOCKS * BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _rng.integers(0, 1 << 63, BLOCKS * BITS // 64, dtype=np.uint64)
#: The number of a block, above the bits of its value.
PLACE = np.arange(BLOCKS, dtype=np.int64) << BITS


def shingle_set(text: str) -> np.ndarray:
    """Hashes of the distinct shingles of a text, in order."""
    w = Words(text)
    return np.unique(w.grams(SHINGLE)) if w.n else np.zeros(1, np.uint64)


def fingerprint(grams: np.ndarray) -> np.ndarray:
    """The words of a fingerprint, of 64 bits each: a bit is 1 if it is set in over half of the hashes."""
    ones = np.zeros(BLOCKS * BITS, np.int64)
    for at in range(0, len(grams), PIECE):
        words = blend(grams[at : at + PIECE, None] * SCALE + SHIFT).astype("<u8", copy=False)
        ones += np.add.reduce(np.unpackbits(words.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(grams), bitorder="little").view("<u8")


def sketches(rows: DataFrame) -> DataFrame:
    """``rows(row_, text)`` to (row_, node, blocks, a, b): a hash of the set, the blocks of its fingerprint and the first 128 bits."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            sets = [shingle_set(x) for x in b.column(1).to_pylist()]
            nodes = np.array([blend(blend(g).sum(dtype=np.uint64, keepdims=True))[0] for g in sets], np.uint64)
            prints = np.stack([fingerprint(g) for g in sets])
            blocks = (prints.view("<u2").astype(np.int64) + PLACE).ravel()
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(blocks) + 1, BLOCKS), pa.int32()), pa.array(blocks))
            first = [pa.array(np.ascontiguousarray(prints[:, i]).view(np.int64)) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(nodes.view(np.int64)), lists, *first], ["row_", "node", "blocks", "a", "b"])

    return rows.select("row_", whole_text().alias("text")).mapInArrow(run, "row_ long, node long, blocks array<long>, a long, b long")


def shingle_sets(rows: DataFrame) -> DataFrame:
    """``rows(id, text)`` to (id, grams)."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(x).tobytes() for x in b.column(1).to_pylist()], pa.binary())], ["id", "grams"])

    return rows.select("id", whole_text().alias("text")).mapInArrow(run, "id long, grams binary")


def met(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``nodes(node, blocks, a, b)``, distinct, to links (u, v) that connect all that share a block and lie within the radius."""
    members = nodes.select(F.explode("blocks").alias("bucket"), F.col("node").alias("id"), "a", "b")

    def close(t: pa.Table, i, j) -> np.ndarray:
        a, b = (t[c].to_numpy().view(np.uint64) for c in ("a", "b"))
        return np.bitwise_count(a[i] ^ a[j]) + np.bitwise_count(b[i] ^ b[j]) <= radius

    return bucket_links(members, lambda t: close(t, np.arange(len(t))[:, None], np.arange(len(t))[None, :]), close=close)


def links(nodes: DataFrame, rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``nodes(node, row_, blocks, a, b)``, distinct, and their texts in ``rows(row_, text)`` to verified links (u, v)."""
    group = stage(components(met(nodes)), "met")
    wanted = stage(nodes.select("node", "row_").join(group, "node").select(F.col("label").alias("bucket"), F.col("node").alias("id"), "row_"), "wanted")
    texts = shingle_sets(rows.select("row_", "text").join(wanted, "row_"))
    return bucket_links(wanted.select("bucket", "id").join(texts, "id"), lambda t: alike(t, similarity))


def near_dedup(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each group stays: the one with the smallest (doc_id, text).

    Of rows that repeat a kept row exactly, one stays.  A null doc_id sorts first.
    """
    rows = numbered(docs)
    texts = rows.select(F.col("number_").alias("row_"), row_column("text").alias("text"))
    found = stage(sketches(texts), "sketches")
    nodes = stage(found.groupBy("node").agg(F.min("row_").alias("row_"), *(F.first(c).alias(c) for c in ("blocks", "a", "b"))), "nodes")
    comp = components(links(nodes, texts, similarity))
    group = found.select("row_", "node").join(comp, "node", "left").select(F.col("row_").alias("number_"), F.coalesce("label", "node").alias("group_"))
    return first_of_each(rows, group, docs.columns)
