"""Exact top-k inner products by aggregation without random access.

Queries and rows meet in blocks of bounded size.  In a part of a block each dimension has a list of the rows sorted by
value; a query reads it from the top where its weight is positive and from the bottom where it is negative.  After
each round of sequential reading, a row's score lies between a lower bound (what was read, and the worst value of each
unread list) and an upper bound (the last value read for each unread list).  Rows whose upper bound is below the
k-th lower bound, or below the k-th score of the parts before, are out; a query stops when few enough are left, and their
final scores are resolved.  Parts grow, so that a few rows set the k-th score that most parts are held against.  The
results of the blocks are merged by a window.

Rows: vectors that are null or hold null or non-finite components take no part; shorter vectors count as ended by
zeros.  Rows that repeat a vec_id are candidates each for itself, except for queries of that vec_id.  A null vec_id takes
no part.  Scores beyond 64 bits are given as the nearest long.  Where products may exceed 2^52, which floats cannot
bound, all rows of a part stay candidates and are scored by integers of any size: at such magnitudes the result is
exact, but nothing is saved.  An empty table gives no rows.  Columns other than vec_id and embedding take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import stage

ROWS, QUERIES = 8192, 8192
#: Rows of the first part of a block, of the largest part, and queries that are gone through at a time.
LEAST_PART, MOST_PART, SLICE = 128, 2048, 1024
#: How far the lists are read, round by round; a query stops at ENOUGH * k rows.
DEPTHS, ENOUGH = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.9, 1.0), 2
LONG = 1 << 63


def _matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def nra(q: np.ndarray, v: np.ndarray, own: np.ndarray, k: int, depths: tuple[float, ...] = DEPTHS, floor: np.ndarray | None = None, read: np.ndarray | None = None) -> list[np.ndarray]:
    """For each query the rows that may be among its k best; ``own[i, j]`` bars row j for query i.

    Rows that cannot reach ``floor[i]`` are out as well.  ``read`` is filled with the entries that a query reads of a list.
    """
    n = len(v)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    order = np.argsort(v, axis=0, kind="stable")
    sorted_ = np.take_along_axis(v, order, axis=0)
    low, high = sorted_[0], sorted_[-1]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q)
    active, rows = np.arange(len(q)), np.arange(n)
    for depth in depths:
        t = min(n, max(1, int(np.ceil(n * depth))))
        top, bottom = sorted_[n - t], sorted_[t - 1]  # the last values read from either end
        x = v[rows]
        a, b = up[active], down[active]
        upper = a @ np.maximum(x, top).T + b @ np.minimum(x, bottom).T
        lower = upper if t == n else a @ np.where(x >= top, x, low).T + b @ np.where(x <= bottom, x, high).T
        bar = own[np.ix_(active, rows)]
        lower = np.where(bar, -np.inf, lower)
        few = min(k, len(rows))
        kth = np.partition(lower, len(rows) - few, axis=1)[:, len(rows) - few] if few == k else np.full(len(active), -np.inf)
        alive = (upper >= np.maximum(kth, floor[active])[:, None]) & ~bar
        done = (alive.sum(1) <= ENOUGH * k) | (t == n)
        for i in np.flatnonzero(done):
            out[active[i]] = rows[alive[i]]
        if read is not None:
            read[active[done]] = t
        rows = rows[alive[~done].any(0)] if (~done).any() else rows
        active = active[~done]
        if not len(active):
            break
    return out


def parts(n: int) -> list[tuple[int, int]]:
    """Begin and end of the parts of a block of n rows; each is as long as all before it, within bounds."""
    out, at = [], 0
    while at < n:
        out.append((at, min(n, at + max(LEAST_PART, min(at, MOST_PART)))))
        at = out[-1][1]
    return out


def block_top(q: np.ndarray, qid: np.ndarray, v: np.ndarray, vid: np.ndarray, k: int, share: list | None = None) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(query, row, score) of the k best rows of a block for each of its queries, ties to smaller ids.

    ``share`` gets (entries read, entries) of the lists of each part.
    """
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * max(1, q.shape[1])
    kind = np.float32 if bound < 1 << 23 else np.float64
    best: list[list[tuple[int, int, int]]] = [[] for _ in q]  # (-score, id, row), in order
    floor = np.full(len(q), -np.inf)
    wide = bound >= 1 << 52
    exact_q = [[int(c) for c in x] for x in q] if wide else q
    for at, end in parts(len(v)):
        x, own = v[at:end], qid[:, None] == vid[None, at:end]
        if wide:
            rough = [np.flatnonzero(~y) for y in own]
            whole = [[int(c) for c in y] for y in x]
        else:
            read = np.zeros(len(q))
            rough = nra(q.astype(kind), x.astype(kind), own, k, DEPTHS if at else (1.0,), floor, read)
            if share is not None:
                share.append((float(read.sum()), len(q) * (end - at)))
        for i, rows in enumerate(rough):
            if not len(rows):
                continue
            if wide:
                got = [max(-LONG, min(LONG - 1, sum(a * b for a, b in zip(exact_q[i], whole[j])))) for j in rows]
            else:
                got = (x[rows] @ q[i]).astype(np.int64).tolist()
            best[i] = sorted(best[i] + [(-s, int(vid[at + j]), at + j) for s, j in zip(got, rows.tolist())])[:k]
            if len(best[i]) == k:
                floor[i] = -best[i][-1][0]
    found = [(i, row, -s) for i, b in enumerate(best) for s, _, row in b]
    qs, rs, scores = zip(*found) if found else ((), (), ())
    return np.array(qs, np.int64), np.array(rs, np.int64), list(scores)


def usable(vectors: DataFrame) -> DataFrame:
    """(row, vec_id, v), the components as floor(64 * x)."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(~F.exists("v", bad))
    wide = F.transform("v", lambda x: F.rint(F.lit(64.0) * x) - F.when(F.rint(F.lit(64.0) * x) > F.lit(64.0) * x, F.lit(1.0)).otherwise(F.lit(0.0)))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", wide.alias("v"))


def top_scores(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """``vectors(vec_id, embedding)`` to (query_id, rank, vec_id, score) for vec_id divisible by ``every``."""
    rows = stage(usable(vectors), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    n_rows, n_asked = max(1, -(-rows.count() // ROWS)), max(1, -(-asked.count() // QUERIES))
    dealt = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("rb", dealt(n_rows)).withColumn("qb", spread(n_asked))
    # Both sides come from one table; names of their own keep Spark from pruning a column that the other side has too.
    right = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("w"), dealt(n_asked).alias("qb")).withColumn("rb", spread(n_rows))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        # A side without rows may come without columns.
        va, vb = (t[c].to_pylist() if t.num_rows else [] for t, c in ((a, "v"), (b, "w")))
        if not va or not vb:
            return pa.table({"query": pa.array([], pa.int64()), "query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        width = max(map(len, va + vb))
        ids, qids, mine = a["vec_id"].to_numpy(), b["query_id"].to_numpy(), b["query"].to_numpy()
        rows, out = _matrix(va, width), []
        for at in range(0, len(vb), SLICE):
            some = slice(at, at + SLICE)
            q, r, s = block_top(_matrix(vb[some], width), qids[some], rows, ids, k)
            out.append(pa.table({"query": mine[some][q], "query_id": qids[some][q], "vec_id": ids[r], "score": pa.array(s, pa.int64())}))
        return pa.concat_tables(out)

    met = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInArrow(run, "query long, query_id long, vec_id long, score long")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
