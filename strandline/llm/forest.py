"""Verified links within buckets, given out as a spanning forest.

Members that share a bucket are compared in blocks.  A large bucket is cut into
chunks by hash and each pair of chunks is a task of its own, so that no task holds
more than two chunks, and each emits at most one link less than it has members:
connected members stay connected, but all pairs of a group are never written out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import stage

#: Members of a chunk; a block of so few members is compared along with its neighbours.
CHUNK, SMALL = 128, 16


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the symmetric boolean matrix ``near``."""
    todo, links = np.ones(len(near), bool), []
    while todo.any():
        front = [int(np.argmax(todo))]
        todo[front[0]] = False
        while front:
            i = front.pop()
            new = np.flatnonzero(near[i] & todo)
            todo[new] = False
            front += new.tolist()
            links += [(i, j) for j in new.tolist()]
    return links


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole runs of equal (bucket, lo, hi) in a sorted partition, and where their runs begin and the last ends."""
    rest = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if rest is None else pa.concat_tables([rest, t]).combine_chunks()
        if not len(t):
            continue
        key = np.stack([t[c].to_numpy() for c in ("bucket", "lo", "hi")])
        cuts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1]
        if len(cuts) > 1:
            yield t.slice(0, cuts[-1]).combine_chunks(), cuts
        rest = t.slice(cuts[-1])
    if rest is not None and len(rest):
        yield rest, np.array([0, len(rest)])


def _pairs(cuts: np.ndarray, small: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows that lie in one of the small runs."""
    end = np.repeat(np.where(small, cuts[1:], 0), np.diff(cuts))
    row, i, j = np.arange(len(end)), [], []
    for d in range(1, SMALL):
        row = row[row + d < end[row]]
        i.append(row)
        j.append(row + d)
    return np.concatenate(i), np.concatenate(j)


def sized(members: DataFrame) -> DataFrame:
    """``members(bucket, id)``, distinct, with ``size``, the members of their bucket; lone ones go.

    Sizes are counted with partial sums and joined back as a table of their own, so no task holds a bucket and
    AQE can split a large one.
    """
    n = members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    return members.join(stage(n, "sizes"), "bucket")


def told_apart(members: DataFrame) -> DataFrame:
    """Staged ``members(bucket, id, size)`` without buckets that hold the same members as another one."""
    same = members.groupBy("bucket").agg(F.max("size").alias("n"), F.min("id").alias("a"), F.max("id").alias("z"), F.bit_xor(F.xxhash64("id")).alias("x"))
    first = same.groupBy("n", "a", "z", "x").agg(F.min("bucket").alias("bucket")).select("bucket")
    return members.join(stage(first, "buckets"), "bucket")


def bucket_links(members: DataFrame, near: Callable[[pa.Table], np.ndarray], chunk: int = CHUNK, close: Callable | None = None) -> DataFrame:
    """``members(bucket long, id long, ...)``, distinct in (bucket, id), to links ``(u, v)``.

    ``near`` gets the members of a block and returns their symmetric boolean matrix.  Members that come with the
    ``size`` of their bucket are not counted again.  ``close``, if given, tells which of the pairs of rows (i, j) of a table
    are near; with it the many small blocks of a table are compared at once.
    """
    m = members if "size" in members.columns else sized(members)
    m = m.withColumn("c_", F.ceil(F.col("size") / chunk).cast("int"))
    mine = F.pmod(F.xxhash64("id"), F.col("c_")).cast("int")
    m = m.withColumn("mine_", mine).withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("c_") - 1)))
    m = m.withColumn("lo", F.least("mine_", "other_")).withColumn("hi", F.greatest("mine_", "other_"))
    m = m.drop("size", "c_", "mine_", "other_").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def run(batches):
        for t, cuts in _runs(batches):
            ids, small = t["id"].to_numpy(), np.diff(cuts) <= (SMALL if close else 0)
            if small.any():
                i, j = _pairs(cuts, small)
                keep = close(t, i, j)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[keep]], pa.int64()), pa.array(ids[j[keep]], pa.int64())], ["u", "v"])
            for k in np.flatnonzero(~small).tolist():
                at, end = int(cuts[k]), int(cuts[k + 1])
                if links := spanning(near(t.slice(at, end - at))):
                    a = np.array(links) + at
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a[:, 0]], pa.int64()), pa.array(ids[a[:, 1]], pa.int64())], ["u", "v"])

    return m.mapInArrow(run, "u long, v long")
