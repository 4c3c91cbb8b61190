"""Best-fit packing by the sum-of-squares rule.

A document is tokenized, ended by id 0, and cut only if it is longer than a sequence: all
pieces but the first are then exactly one sequence long.  So a document leaves at most one
piece to pack; full pieces are sequences of their own.  Each piece goes into the open bin that makes the
sum of squared counts of open bins per residual gap smallest: moving a bin from gap g to g - s
changes it by 2 (N[g-s] - N[g]) + 2, filling one by 1 - 2 N[s].

One departure: a bin is opened only where no open one has room, while the rule as published weighs a new bin as well.
The pieces come in descending length and all of them are known, so there is nothing to gain from bins kept open for
what may follow: with new bins weighed the same pieces take more sequences (the README has the figures).

The pieces are dealt by hash into shards of a bounded number of rows, packed one by one
in descending length, so state is two arrays of the capacity's length and the bins of a shard.
What a shard leaves in bins that are not well filled is packed again with the leavings
of other shards.

Rows: a null text counts as empty, which is one piece holding id 0 alone.  Repeated rows are
packed each for itself.  A null doc_id is kept.  An empty table gives no rows.  Columns other than doc_id and text
take no part.
"""

from __future__ import annotations

import base64
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage, whole_text

CAPACITY = 2048
END = 0
#: Pieces of a shard, on average.
SHARD = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


@lru_cache(maxsize=2)
def encoder(ranks: str):
    """The byte-level BPE of a rank file.  Its ids equal those of the JSON file of the same vocabulary."""
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={"<|endoftext|>": len(table)})


def token_ids(text: str, ranks: str) -> np.ndarray:
    return np.array([*encoder(ranks).encode(text, allowed_special="all"), END], dtype="<u4")


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids."""
    first = n if n <= capacity else n % capacity or capacity
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def pieces(docs: DataFrame, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, text)`` to a row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        for b in batches:
            rows = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = token_ids(text, ranks)
                rows += [(doc, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cuts(len(ids), capacity))]
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text")).mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int, weigh_opening: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, the items taken in the given order.

    With ``weigh_opening`` a new bin, which adds 1 + 2 N[capacity - s], is a choice like any other; else it is the
    last resort.
    """
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; gap 0 is closed and counts nothing
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, used = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    closed = np.iinfo(np.int64).max
    for i, s in enumerate(lengths.tolist()):
        have = count[s:]
        change = np.where(have > 0, 2 * (count[: capacity + 1 - s] - have) + 2, closed)
        if have[0] > 0:
            change[0] = 1 - 2 * have[0]
        j = int(np.argmin(change))
        if change[j] < closed and not (weigh_opening and s < capacity and 1 + 2 * count[capacity - s] < change[j]):
            g = s + j
            b = at[g].pop()
            count[g] -= 1
        else:
            g, b, used = capacity, used, used + 1
        bins[i], offsets[i] = b, capacity - g
        if g > s:
            at[g - s].append(b)
            count[g - s] += 1
    return bins, offsets


def pack_rows(rows: pa.Table, capacity: int, filled: float, base: int) -> pa.Table:
    """Rows with ``length`` get ``offset`` and ``sequence_id``, which is -1 in bins that are filled to less than ``filled``.

    Only lengths, hashes and row numbers, which are never null, become arrays; ids stay in the table.
    """
    length, mix, row = (rows[c].to_numpy() for c in ("length", "mix", "row"))
    order = np.lexsort((row, mix, -length))
    bins, offsets = sum_of_squares(length[order], capacity)
    full = np.bincount(bins, length[order])[bins] >= filled * capacity
    rows = rows.take(pa.array(order))
    return rows.append_column("offset", pa.array(offsets, pa.int64())).append_column("sequence_id", pa.array(np.where(full, base + bins, -1), pa.int64()))


def pack(rows: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, filled: float = 0.97) -> DataFrame:
    """Staged pieces with ``row`` (unique) and ``length`` get ``sequence_id`` and ``offset``."""
    kind = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    part = rows.where(F.col("length") < capacity)
    shards = max(1, -(-part.count() // shard))
    part = part.withColumn("mix", F.xxhash64("row")).withColumn("shard", F.pmod("mix", F.lit(shards)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        return pack_rows(table, capacity, filled, table["shard"][0].as_py() << 32)

    first = part.groupBy("shard").applyInArrow(run, f"{kind}, mix long, shard long, offset long, sequence_id long")
    first = stage(first, "packed")
    left = first.where("sequence_id < 0").drop("offset", "sequence_id")
    again = max(1, -(-left.count() // shard))
    left = left.withColumn("shard", F.pmod(F.xxhash64("mix", F.lit(1)), F.lit(again)).cast("long"))

    def rerun(table: pa.Table) -> pa.Table:
        return pack_rows(table, capacity, 0, ((1 << 30) + table["shard"][0].as_py()) << 32)

    second = left.groupBy("shard").applyInArrow(rerun, f"{kind}, mix long, shard long, offset long, sequence_id long")
    names = [*rows.columns, "sequence_id", "offset"]
    whole = rows.where(F.col("length") >= capacity).withColumn("sequence_id", -F.col("row") - 1).withColumn("offset", F.lit(0).cast("long"))
    return whole.select(names).unionByName(first.where("sequence_id >= 0").select(names)).unionByName(second.select(names))


def packed(docs: DataFrame, ranks: str, capacity: int = CAPACITY) -> DataFrame:
    """``docs(doc_id, text)`` to pieces with their place in sequences."""
    rows = stage(pieces(docs, ranks, capacity).withColumn("row", F.monotonically_increasing_id()), "pieces")
    return pack(rows, capacity).drop("row")
