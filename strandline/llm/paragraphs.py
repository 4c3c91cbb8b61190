"""Substring dedup by paragraph MinHash banding.

Passages that repeat may begin and end in the middle of lines, so paragraphs are found by content.  Of each run of
GAP shingles the one with the least hash is an anchor, so anchors are at most GAP words apart; one within NEAR words of
the anchor before it, or of the end, is merged with that.  A paragraph is the run of WORDS words that begins at an anchor.  The first and
the last words of a text are paragraphs too, so paragraphs cover every word.  A run of GAP + WORDS words or more
that two texts share has the same least shingle in both, and so holds a paragraph that is equal in both, or
shifted by NEAR words at most, where the anchors around it differ, and then alike by the similarity that is asked for.

MinHash values of word shingles are banded with two rows a band, so that a pair at the threshold meets with
probability over 0.98; colliding nodes, which are the distinct paragraphs, are verified by exact Jaccard
similarity of their shingles; classes are connected components.  A class with two places that do not overlap, in two documents
or in one, is reported with all its places.  The first place, by (doc_id, start), stays; those that do not overlap it
are removed.

Rows: a null or empty text has no paragraph, as has a text of fewer than ``least`` words; one shorter
than a paragraph is a single paragraph.  Rows that repeat exactly count as one document.  A null doc_id is a
document too and sorts first.  An empty table gives no rows.  Columns other than doc_id and text take no part.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, stage, whole_text
from .components import components
from .forest import bucket_links, sized, told_apart
from .simhash import LOWER

WORDS, LEAST, SHINGLE, SIMILARITY = 26, 20, 5, 0.8
GAP, NEAR = 24, 2
#: Bits of a place that hold its first word; characters of texts that are gone through at a time.
START_BITS, PART = 20, 1 << 19
#: Paragraphs of a chunk that is compared with another, and cells of a matrix that are counted at a time.
CHUNK, CELLS = 256, 1 << 22
BANDS, ROWS = 4, 2
BASE, STEP = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
_rng = np.random.default_rng(5)
SCALE = _rng.integers(1, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64)


def powers(base: int, n: int) -> np.ndarray:
    return _powers(base, max(1024, 1 << (n - 1).bit_length()))[:n] if n else np.zeros(0, np.uint64)


def blend(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(STEP)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(BASE)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of texts, one after the other, with their hashes; ``n`` words in all."""

    def __init__(self, *texts: str):
        parts = [t.encode("utf-8", "surrogatepass").translate(LOWER) for t in texts]
        raw = np.frombuffer(b"\n".join(parts), np.uint8)
        gap = SPACE[raw]
        edge = np.diff(np.r_[True, gap, True].astype(np.int8))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        self.n = len(starts)
        #: Of each text the first word, and after the last text the number of words.
        self.first = np.searchsorted(starts, np.cumsum([0, *(len(p) + 1 for p in parts)]))
        self.hash = np.zeros(0, np.uint64)
        if self.n:
            sums = np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(raw)), dtype=np.uint64)]
            self.hash = blend((sums[ends] - sums[starts]) * powers(pow(BASE, -1, 1 << 64), len(raw))[starts])

    def grams(self, k: int) -> np.ndarray:
        """Hashes of the runs of k words; of all words if they are fewer."""
        k = min(k, self.n)
        out = np.zeros(self.n - k + 1, np.uint64)
        for j in range(k):
            out = (out + self.hash[j : self.n - k + 1 + j]) * np.uint64(STEP)
        return blend(out)


def _sliding(f, x: np.ndarray, n: int) -> np.ndarray:
    """``f``, a minimum or maximum, of each run of n values, by doubling."""
    width, out = 1, x
    while 2 * width <= n:
        out, width = f(out[:-width], out[width:]), 2 * width
    return f(out[: len(x) - n + 1], out[n - width :][: len(x) - n + 1])


def anchors(value: np.ndarray, whole: np.ndarray, gap: int) -> np.ndarray:
    """Where a value is the least of a run of ``gap`` values; ``whole`` tells which runs lie in one text."""
    if len(value) < gap:
        return np.zeros(0, np.int64)
    least = np.where(whole, _sliding(np.minimum, value, gap), np.uint64(0))
    pad = np.zeros(gap - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.maximum, np.r_[pad, least, pad], gap) == value)
    near = np.flatnonzero((value[at[1:]] == value[at[:-1]]) & (np.diff(at) < gap))
    if len(near):  # of equal values in one run the first is taken
        runs = np.flatnonzero(whole)
        view = np.lib.stride_tricks.sliding_window_view(value, gap)
        at = np.unique(np.concatenate([r + view[r].argmin(1) for r in np.array_split(runs, len(runs) // 65536 + 1)] or [at]))
    return at


def paragraphs(w: Words, size: int = WORDS, least: int = LEAST, gap: int = GAP, near: int = NEAR) -> np.ndarray:
    """The first words of the paragraphs of all texts, in order."""
    head, count = w.first[:-1], np.diff(w.first)
    end = head + np.maximum(count - size, 0)  # where the last paragraph of a text begins
    ends = np.unique(end[count >= least])
    heads = head[(count >= least) & (count > size)]
    if not len(heads):
        return ends
    value = w.grams(SHINGLE)
    text = np.repeat(np.arange(len(count)), count)
    reach = gap + SHINGLE - 1  # the words of a run of shingles
    whole = text[: max(0, w.n - reach + 1)] == text[reach - 1 :]
    at = anchors(value, whole[: len(value) - gap + 1], gap)
    at = at[at < end[text[at]] - near]
    every = np.unique(np.r_[heads, at])
    mine = text[every]
    close = np.flatnonzero((np.diff(every) <= near) & (mine[1:] == mine[:-1])) + 1
    keep = np.ones(len(every), bool)
    for i in close.tolist():  # few: each is measured from the last one that stays
        j = i - 1
        while not keep[j]:
            j -= 1
        keep[i] = every[i] - every[j] > near
    return np.unique(np.r_[every[keep], ends])


def band_keys(w: Words, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(paragraph hash, band keys) of the paragraphs of ``size`` words that begin at ``at``."""
    k = min(SHINGLE, size, w.n)
    own = w.grams(k)[at[:, None] + np.arange(size - k + 1)]
    bands = np.empty((len(at), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(at), b, np.uint64)
        for i in range(ROWS * b, ROWS * b + ROWS):
            key = blend(key * np.uint64(BASE) + (own * SCALE[i] + SHIFT[i]).min(1))
        bands[:, b] = key
    whole = (own * powers(STEP, own.shape[1])).sum(1, dtype=np.uint64)
    return blend(whole + np.uint64(size)), bands


BAND_NAMES = [f"band{i}" for i in range(BANDS)]
PLACES = "doc_id long, row_hash long, start int, words int, node long, " + ", ".join(f"{b} long" for b in BAND_NAMES)


def place_of(row_hash: Column, start: Column) -> Column:
    """A place as a long: the upper bits of the text's hash and the first word, so places of a text follow each other."""
    return row_hash.bitwiseAND(F.lit(-1 << START_BITS)).bitwiseOR(F.least(start, F.lit((1 << START_BITS) - 1)).cast("long"))


def find(docs: DataFrame, size: int = WORDS, least: int = LEAST) -> DataFrame:
    """``docs(doc_id, text)`` to a row per paragraph: doc_id, row_hash, start, words, node and its bands."""

    def run(batches):
        for b in batches:
            texts = b.column(2).to_pylist()
            sizes = np.cumsum([len(t) for t in texts])
            at = 0
            while at < len(texts):  # a few texts at a time
                end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + PART, side="right")))
                w = Words(*texts[at:end])
                first, count = w.first[:-1], np.diff(w.first)
                places = paragraphs(w, size, least)
                if len(places):
                    row = np.searchsorted(w.first, places, side="right") - 1
                    words = np.minimum(size, count[row])
                    node, bands = np.empty(len(places), np.uint64), np.empty((len(places), BANDS), np.uint64)
                    for n in np.unique(words).tolist():  # one length but for short texts
                        some = words == n
                        node[some], bands[some] = band_keys(w, places[some], n)
                    take, long = pa.array(row + at), lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
                    start = pa.array(places - first[row], pa.int32())
                    yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), start, pa.array(words, pa.int32()), long(node), *map(long, bands.T)], [c.split()[0] for c in PLACES.split(", ")])
                at = end

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("row_hash"), whole_text().alias("text"))
    return rows.mapInArrow(run, PLACES)


def shingles(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, grams) of the paragraphs in ``wanted(doc_id, row_hash, start, words, id)``."""
    asked = wanted.groupBy(F.col("doc_id").alias("d"), F.col("row_hash").alias("h")).agg(F.collect_set(F.struct("id", "start", "words")).alias("asked"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("row_hash"), whole_text().alias("text"))
    rows = rows.join(asked, (F.col("row_hash") == F.col("h")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("text", "asked")

    def run(batches):
        for b in batches:
            out = []
            for text, asked in zip(*(c.to_pylist() for c in b.columns)):
                w = Words(text)
                for a in asked:
                    k = min(SHINGLE, a["words"])
                    out.append((a["id"], w.grams(k)[a["start"] : a["start"] + a["words"] - k + 1].tobytes()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.binary()))], ["id", "grams"])

    return rows.mapInArrow(run, "id long, grams binary")


def alike(t: pa.Table, similarity: float = SIMILARITY) -> np.ndarray:
    """Which members of a block have a Jaccard similarity of at least ``similarity``."""
    sets = [np.unique(np.frombuffer(x, np.uint64)) for x in t["grams"].to_pylist()]
    sizes = np.array([len(s) for s in sets])
    _, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, both = np.repeat(np.arange(len(sets)), sizes), np.diag(sizes).astype(np.float64)
    shared = n[at] > 1  # what one set alone has counts in its size only
    at, owner = np.unique(at[shared], return_inverse=True)[1], owner[shared]
    order = np.argsort(at, kind="stable")
    at, owner, step = at[order], owner[order], max(1, CELLS // len(sets))
    pairs = np.zeros(both.shape)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, step):
        a, z = np.searchsorted(at, [low, low + step])
        here = at[a:z] - low
        bits = np.zeros((len(sets), (min(step, int(here[-1]) + 1) + 63) // 64), np.uint64)
        np.bitwise_or.at(bits, (owner[a:z], here >> 6), np.uint64(1) << (here & 63).astype(np.uint64))
        for i in range(len(sets)):
            pairs[i] += np.bitwise_count(bits & bits[i]).sum(1)
    both = np.maximum(both, pairs)
    return both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-6


def colliding(nodes: DataFrame, size: int) -> DataFrame:
    """(bucket, id, size): the nodes that share a bucket with others, but for overlapping ones of one text.

    Buckets are told by partial sums first; those with several nodes are joined back as a table of their own, so no task
    holds a bucket and AQE can split one that very many paragraphs share.  The join is of one kind at every size.
    """
    keys = nodes.select("id", F.explode(F.array(*BAND_NAMES)).alias("bucket"))
    ends = keys.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("z"))
    text, start = (lambda c: F.shiftright(c, START_BITS)), (lambda c: F.col(c).bitwiseAND(F.lit((1 << START_BITS) - 1)))
    apart = (text("a") != text("z")) | (start("z") - start("a") >= size)
    several = stage(ends.where(apart).select("bucket"), "several")
    met = stage(keys.join(several.hint("merge"), "bucket").select("bucket", "id").distinct(), "met")
    return told_apart(stage(sized(met), "met_sized"))


def repeats(docs: DataFrame, size: int = WORDS, least: int = LEAST, similarity: float = SIMILARITY) -> DataFrame:
    """Paragraphs that repeat across documents or within one, a row for each place.

    ``docs(doc_id, text)`` to (doc_id, row_hash, start_word, n_words, class_id, kept_doc_id, kept_start_word, removed).
    """
    found = stage(find(docs, size, least), "found")
    place = place_of(F.col("row_hash"), F.col("start"))
    # A node is known by its least place, which tells neighbours in a text from paragraphs of others.
    nodes = found.withColumn("id", place).groupBy("node").agg(F.min("id").alias("id"), F.count("*").alias("n"), *(F.min(b).alias(b) for b in BAND_NAMES))
    nodes, places = stage(nodes, "nodes"), stage(found.drop(*BAND_NAMES), "places")
    discard(found)  # the bands, most of its bytes, are in the nodes
    met = stage(colliding(nodes, size), "met_once")
    where = places.select("node", F.struct("doc_id", "row_hash", "start", "words").alias("here"))
    asked = stage(nodes.select("id", "node").join(met.select("id").distinct(), "id"), "asked")
    wanted = stage(where.join(asked, "node").groupBy("id").agg(F.min("here").alias("here")).select("here.*", "id"), "wanted")
    members = met.join(shingles(docs, wanted), "id").select("bucket", "id", "size", "grams")
    comp = stage(components(bucket_links(members, lambda t: alike(t, similarity), CHUNK)), "classes")
    # Only nodes with two places or with links can be of a class that repeats.
    named = nodes.select("node", "id", "n").join(comp.select(F.col("node").alias("id"), "label"), "id", "left").where("n > 1 or label is not null")
    named = named.select("node", F.coalesce("label", "id").alias("class_id"))
    found = stage(where.join(stage(named, "named"), "node").select("class_id", "here"), "found")
    ends = found.groupBy("class_id").agg(F.min("here").alias("first"), F.max("here").alias("last"))
    one = F.struct("first.doc_id", "first.row_hash").eqNullSafe(F.struct("last.doc_id", "last.row_hash"))
    ends = ends.where(~(one & (F.col("last.start") < F.col("first.start") + F.col("first.words"))))
    rows = found.join(stage(ends.select("class_id", "first"), "keepers"), "class_id").select("class_id", "first", "here.*")
    same = F.struct("doc_id", "row_hash").eqNullSafe(F.struct("first.doc_id", "first.row_hash"))
    stays = same & (F.col("start") < F.col("first.start") + F.col("first.words"))
    return rows.select(
        "doc_id", "row_hash", F.col("start").alias("start_word"), F.col("words").alias("n_words"), "class_id",
        F.col("first.doc_id").alias("kept_doc_id"), F.col("first.start").alias("kept_start_word"), (~stays).alias("removed"),
    )
