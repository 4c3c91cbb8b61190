"""Colinear chains of matches: the best-scoring paths through a read's matches in a contig."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F


@dataclass
class Chain:
    score: int
    members: list[int]


def chain_matches(q: np.ndarray, r: np.ndarray, size: np.ndarray, max_gap: int = 10_000, least: int = 10, score: np.ndarray | None = None) -> list[Chain]:
    """Chains of the matches of one read, strand and contig, in the order they are taken.

    A match adds its score to its best predecessor's less the larger of the two gaps, if that is more than
    its score alone.  Predecessors end at or before it on both axes, within ``max_gap``.  The best end is taken
    first, its path runs back to the first match already taken, and a path counts if its own score is enough.
    """
    score = size if score is None else score
    order = np.lexsort((r, q))
    q, r, size, score = q[order], r[order], size[order], score[order]
    total, back = score.astype(np.int64).copy(), np.full(len(q), -1)
    for i in range(1, len(q)):
        dq, dr = q[i] - q[:i] - size[:i], r[i] - r[:i] - size[:i]
        gap = np.maximum(dq, dr)
        value = np.where((dq >= 0) & (dr >= 0) & (gap <= max_gap), total[:i] - gap, -1)
        j = int(value.argmax())
        if value[j] > 0:
            total[i] += value[j]
            back[i] = j
    free, out = np.ones(len(q), bool), []
    for top in np.argsort(-total, kind="stable"):
        if total[top] < least:
            break
        if not free[top]:
            continue
        path, at = [], int(top)
        while at >= 0 and free[at]:
            free[at] = False
            path.append(at)
            at = int(back[at])
        path.reverse()
        own = int(score[path[0]])
        for a, b in zip(path, path[1:]):
            own += int(score[b]) - int(max(q[b] - q[a] - size[a], r[b] - r[a] - size[a]))
        if own >= least:
            out.append(Chain(own, order[path].tolist()))
    return out


CHAINS = "read_id long, strand string, ref_id long, chain_no int, score int, query_begin int, query_end int, ref_begin int, ref_end int, mems array<struct<qpos:int,rpos:int,len:int>>"
GROUP = ("read_id", "strand", "ref_id")


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of a sorted partition in parts that do not cut a group."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        last = [t[c][t.num_rows - 1] for c in GROUP] if t.num_rows else []
        same = np.ones(t.num_rows, bool)
        for c, v in zip(GROUP, last):
            same &= pc.equal(t[c], v).to_numpy(zero_copy_only=False).astype(bool)
        at = t.num_rows - int(same.sum())  # sorted, so the last group is the end
        if at:
            yield t.slice(0, at)
        rest = t.slice(at)
    if rest is not None and rest.num_rows:
        yield rest


def chains(mems: DataFrame, max_gap: int, least: int) -> DataFrame:
    """Chains of each (read, strand, contig).

    The matches are dealt by read and sorted, and a task goes through its groups a batch at a time, so a group costs no call
    of its own and most, which hold one match, cost next to nothing.
    """

    def run(batches):
        for t in _whole_groups(batches):
            ref, forward, read = t["ref_id"].to_numpy(), pc.equal(t["strand"], "+").to_numpy(zero_copy_only=False).astype(bool), t["read_id"].to_numpy()
            q, r, n = (t[c].to_numpy() for c in ("qpos", "rpos", "len"))
            edge = np.flatnonzero((read[1:] != read[:-1]) | (ref[1:] != ref[:-1]) | (forward[1:] != forward[:-1])) + 1
            heads, rows, members = [], [], []
            for a, z in zip([0, *edge.tolist()], [*edge.tolist(), len(q)]):
                if z - a == 1:
                    found = [(int(n[a]), [a])] if n[a] >= least else []
                else:
                    found = [(c.score, [a + i for i in c.members]) for c in chain_matches(q[a:z], r[a:z], n[a:z], max_gap, least)]
                for k, (score, at) in enumerate(found):
                    heads.append(at[0])
                    rows.append((k, score, q[at[0]], q[at[-1]] + n[at[-1]], r[at[0]], r[at[-1]] + n[at[-1]], len(at)))
                    members += at
            if not heads:
                continue
            cols = np.array(rows, np.int64).T
            take, inner = pa.array(heads), np.array(members)
            parts = pa.StructArray.from_arrays([pa.array(x[inner], pa.int32()) for x in (q, r, n)], ["qpos", "rpos", "len"])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(cols[6])], pa.int32()), parts)
            key = [t[c].combine_chunks().take(take) for c in GROUP]
            yield pa.RecordBatch.from_arrays([*key, *(pa.array(c, pa.int32()) for c in cols[:6]), lists], [x.split()[0] for x in CHAINS.split(", ")])

    m = mems.select(*(F.col(c).cast(t).alias(c) for c, t in (("read_id", "long"), ("strand", "string"), ("ref_id", "long"), ("qpos", "int"), ("rpos", "int"), ("len", "int"))))
    return m.repartition("read_id").sortWithinPartitions(*GROUP, "qpos", "rpos").mapInArrow(run, CHAINS)


def ranked(found: DataFrame, most: int | None = None) -> DataFrame:
    """Chains with ``chain_rank`` per read, best first, ``next_score``, the score of the second, and ``best``, the first one's place."""
    order = Window.partitionBy("read_id").orderBy(F.desc("score"), "ref_id", "ref_begin", "query_begin", F.desc(F.col("strand") == "+"), "chain_no")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = F.first(F.struct("ref_id", "query_begin", "query_end")).over(whole)
    out = found.withColumn("chain_rank", F.row_number().over(order)).withColumn("next_score", F.nth_value("score", 2).over(whole)).withColumn("best", best)
    return out if most is None else out.where(F.col("chain_rank") <= most)
