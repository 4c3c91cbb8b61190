"""Pairwise alignment kernels.

Pairs are aligned in batches: a batch holds pairs of similar size, the loop runs over the rows of
the dynamic programming table, and each row is computed for all pairs at once.  Gaps along the row are a
running maximum.  Spark calls the kernels through Arrow, a column batch at a time.

Conventions: codes 0 to 3 are bases and 4 is N, which never matches; positions are half-open; a gap of length
L costs ``gap_open + L * gap_ext``; of equal choices the diagonal comes first, then a gap in the query (deletion), then a gap
in the reference (insertion); of equal ends the first in row order is taken.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..config import Scoring

NONE = -(1 << 28)
STOP, DIAGONAL, ALONG, DOWN = 0, 1, 2, 3
BATCH = 128
CODES = np.full(256, 4, np.uint8)
CODES[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3] * 2


@dataclass
class Alignment:
    score: int = 0
    ref_begin: int = 0
    ref_end: int = 0
    query_begin: int = 0
    query_end: int = 0
    cigar: tuple[tuple[str, int], ...] = ()

    def count(self, kinds: str) -> int:
        return sum(n for op, n in self.cigar if op in kinds)

    @property
    def mismatches(self) -> int:
        return self.count("X")

    @property
    def gap_opens(self) -> int:
        return sum(op in "ID" for op, _ in self.cigar)

    @property
    def gap_bases(self) -> int:
        return self.count("ID")

    def text(self) -> str:
        return "".join(f"{n}{op}" for op, n in self.cigar) or "*"


def codes(sequence: str) -> np.ndarray:
    return CODES[np.frombuffer(sequence.encode("ascii", "replace"), np.uint8)]


def _padded(parts: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts))), fill, np.uint8)
    for row, p in zip(out, parts):
        row[: len(p)] = p
    return out


def _runs(ops: str) -> tuple[tuple[str, int], ...]:
    cuts = [0, *(i for i in range(1, len(ops)) if ops[i] != ops[i - 1]), len(ops)]
    return tuple((ops[a], b - a) for a, b in zip(cuts, cuts[1:]) if b > a)


def _table(queries, refs, sc: Scoring, band: np.ndarray | None, local: bool, drop: int | None = None):
    """Fill the tables of a batch; returns (moves, best score, end row, end column) per pair."""
    q, r = _padded(queries, 5), _padded(refs, 6)
    b, m, n = len(q), q.shape[1], r.shape[1]
    column = np.arange(n + 1, dtype=np.int32)
    opening = sc.gap_open + sc.gap_ext
    edge = np.zeros(n + 1, np.int32) if local else np.r_[0, sc.gap_open + sc.gap_ext * column[1:]].astype(np.int32)
    h = np.tile(edge, (b, 1))
    down = np.full((b, n + 1), NONE, np.int32)
    if band is not None:
        h[column[None, :] > band[:, None]] = NONE
    moves = np.zeros((b, m + 1, n + 1), np.uint8)
    best, row, col = np.zeros(b, np.int32), np.zeros(b, np.int32), np.zeros(b, np.int32)
    live = np.ones(b, bool)
    for i in range(1, m + 1):
        here = q[:, i - 1 : i]
        match = np.where((here == r) & (here < 4), np.int32(sc.match), np.int32(sc.mismatch))
        fresh = h + opening
        down = np.maximum(down + sc.gap_ext, fresh)
        from_h = down == fresh
        diagonal = np.empty_like(h)
        diagonal[:, 1:] = h[:, :-1] + match
        diagonal[:, 0] = 0 if local else NONE
        top = np.maximum(diagonal, down)
        if local:
            np.maximum(top, 0, out=top)
        else:
            top[:, 0] = sc.gap_open + sc.gap_ext * i
        outside = None if band is None else np.abs(column[None, :] - i) > band[:, None]
        if outside is not None:
            top[outside] = NONE
        along = np.full_like(h, NONE)
        along[:, 1:] = np.maximum.accumulate(top - sc.gap_ext * column, axis=1)[:, :-1] + sc.gap_open + sc.gap_ext * column[1:]
        now = np.maximum(top, along)
        if outside is not None:
            now[outside] = NONE
        move = np.where(now == diagonal, DIAGONAL, np.where(now == along, ALONG, DOWN)).astype(np.uint8)
        if local:
            move[now <= 0] = STOP
        opened = np.zeros((b, n + 1), bool)
        opened[:, 1:] = along[:, 1:] == now[:, :-1] + opening
        moves[:, i] = move | (opened << 2) | (from_h << 3)
        h = now
        if local:
            at = h.argmax(1)
            top_score = h[np.arange(b), at]
            if drop is not None:
                live &= (i <= 1) | (top_score >= best - drop)
            better = live & (top_score > best)
            best[better], row[better], col[better] = top_score[better], i, at[better]
        else:
            ends = np.array([len(x) == i for x in queries])
            size = np.array([len(x) for x in refs])
            best[ends], row[ends], col[ends] = h[ends, size[ends]], i, size[ends]
    return moves, best, row, col


def _trace(moves: np.ndarray, query, ref, i: int, j: int, local: bool) -> tuple[str, int, int]:
    """(operations, first row, first column) of the path that ends at (i, j)."""
    out, state = [], 0
    while i > 0 or j > 0:
        if not local and (i == 0 or j == 0):
            out.append("D" if i == 0 else "I")
            i, j = (i, j - 1) if i == 0 else (i - 1, j)
            continue
        cell = int(moves[i, j])
        state = state or cell & 3
        if state == STOP:
            break
        if state == DIAGONAL:
            i, j = i - 1, j - 1
            out.append("=" if query[i] == ref[j] and query[i] < 4 else "X")
            state = 0
        elif state == ALONG:
            j -= 1
            out.append("D")
            state = 0 if cell & 4 else ALONG
        else:
            i -= 1
            out.append("I")
            state = 0 if cell & 8 else DOWN
        if local and (i == 0 or j == 0) and not state:
            break
    return "".join(reversed(out)), i, j


def _unclipped(a: Alignment, query: np.ndarray, ref: np.ndarray, sc: Scoring, ops: str) -> tuple[Alignment, str]:
    """Extend clipped ends without gaps if that costs no more than the clipping penalties."""
    head, tail = a.query_begin, len(query) - a.query_end
    if not sc.clip or not (head or tail) or a.ref_begin < head or a.ref_end + tail > len(ref):
        return a, ops
    same = lambda q, r: "".join("=" if x == y and x < 4 else "X" for x, y in zip(q, r))
    before, after = same(query[:head], ref[a.ref_begin - head : a.ref_begin]), same(query[len(query) - tail :], ref[a.ref_end : a.ref_end + tail])
    hits = (before + after).count("=")
    forced = a.score + hits * sc.match + (head + tail - hits) * sc.mismatch
    if forced + abs(sc.clip) * (bool(head) + bool(tail)) < a.score:
        return a, ops
    return Alignment(forced, a.ref_begin - head, a.ref_end + tail, 0, len(query)), before + ops + after


def _finish(a: Alignment, ops: str, size: int) -> Alignment:
    clip = lambda n: (("S", n),) if n else ()
    a.cigar = clip(a.query_begin) + _runs(ops) + clip(size - a.query_end)
    return a


def align_local(queries: list[np.ndarray], refs: list[np.ndarray], sc: Scoring = Scoring(), band: int = 0, unclip: bool = False, drop: int | None = None) -> list[Alignment]:
    """Local alignments, best first end; ``band`` 0 is the whole table, else it is at least the difference in length and 1."""
    out = [Alignment() for _ in queries]
    some = [i for i, (q, r) in enumerate(zip(queries, refs)) if len(q) and len(r)]
    some.sort(key=lambda i: (len(queries[i]), len(refs[i])))
    for at in range(0, len(some), BATCH):
        part = some[at : at + BATCH]
        qs, rs = [queries[i] for i in part], [refs[i] for i in part]
        width = np.array([max(band, abs(len(q) - len(r)) + 1) for q, r in zip(qs, rs)]) if band else None
        moves, best, row, col = _table(qs, rs, sc, width, True, drop)
        for k, i in enumerate(part):
            if best[k] <= 0:
                continue
            ops, qb, rb = _trace(moves[k], qs[k], rs[k], int(row[k]), int(col[k]), True)
            a = Alignment(int(best[k]), rb, int(col[k]), qb, int(row[k]))
            if unclip:
                a, ops = _unclipped(a, qs[k], rs[k], sc, ops)
            out[i] = _finish(a, ops, len(qs[k]))
    return out


def semi_global(queries, refs, sc: Scoring = Scoring(), band: int = 32) -> list[Alignment]:
    """What reads are extended with: local, banded, then un-clipped."""
    return align_local(queries, refs, sc, band, unclip=True)


def extend(queries, refs, sc: Scoring = Scoring(), band: int = 32, drop: int = 100) -> list[Alignment]:
    """Local, given up once a row falls ``drop`` below the best."""
    return align_local(queries, refs, sc, band, drop=drop)


def align_global(queries, refs, sc: Scoring = Scoring()) -> list[Alignment]:
    """End-to-end alignments with affine gaps."""
    out = []
    for q, r in zip(queries, refs):
        if not len(q) or not len(r):
            n = max(len(q), len(r))
            out.append(Alignment(sc.gap_open + n * sc.gap_ext if n else 0, 0, len(r), 0, len(q), (("I" if len(q) else "D", n),) if n else ()))
            continue
        moves, best, row, col = _table([q], [r], sc, None, False)
        ops, _, _ = _trace(moves[0], q, r, len(q), len(r), False)
        out.append(Alignment(int(best[0]), 0, len(r), 0, len(q), _runs(ops)))
    return out


def md_text(a: Alignment, ref: np.ndarray) -> str:
    """The MD tag of an alignment along the forward reference."""
    out, run, at = [], 0, a.ref_begin
    letters = "ACGTN"
    for op, n in a.cigar:
        if op == "=":
            run, at = run + n, at + n
        elif op == "X":
            for _ in range(n):
                out.append(f"{run}{letters[ref[at]]}")
                run, at = 0, at + 1
        elif op == "D":
            out.append(f"{run}^" + "".join(letters[c] for c in ref[at : at + n]))
            run, at = 0, at + n
    return "".join(out) + str(run)


RESULT = "score int, ref_begin int, ref_end int, query_begin int, query_end int, cigar string, nm int, md string"


def aligner(sc: Scoring, band: int, kind: str = "semi_global"):
    """A pandas UDF of (query, reference) strings that returns RESULT."""

    @F.pandas_udf(RESULT)
    def sw_align(query: pd.Series, ref: pd.Series) -> pd.DataFrame:
        qs, rs = [codes(x or "") for x in query], [codes(x or "") for x in ref]
        found = semi_global(qs, rs, sc, band) if kind == "semi_global" else align_global(qs, rs, sc) if kind == "global" else align_local(qs, rs, sc, band)
        rows = [(a.score, a.ref_begin, a.ref_end, a.query_begin, a.query_end, a.text(), a.count("XID"), md_text(a, r)) for a, r in zip(found, rs)]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RESULT.split(", ")])

    return sw_align
