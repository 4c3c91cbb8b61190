"""Extra columns with clashing names, ids beyond floats, and properties of fits, bounds and hot digests."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import linejoin, media, mixing, nearcopies, packing, paragraphs, preference, quality, simhash, topk, warc
from strandline.llm.queries import tokenizer_ranks

from test_near import DOCS, frame, prose

#: Names that operators use for columns of their own, and names that their results have.
NAMES = """size taken score stats key row_ d_ h_ s_ n_ t_ w_ r_ y_ text_ kept_ key_ gone_ gone mine_ number number_ group_ node label bucket id fp line u v a b rank sequence_id offset first last bands
row_hash class_id words start here n target epochs range_ own_ base_ times_ piece length mix shard media_sha chunks digest data payload sha refers_to hash_ left untouched plan_at plan_size plan_taken""".split()


def prepared(spark, rows=None):
    rng = random.Random(4)
    rows = rows or [(i, " ".join(prose(rng, 60)) + "\na line that is repeated in every text\nLes.", "en", "ab"[i % 2], 400) for i in range(6)]
    d = frame(spark, rows, DOCS)
    return d.select("*", *(F.lit(f"extra {c}").alias(c) for c in NAMES))


STAGES = dict(corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", [k for k in STAGES if k != "packing"])
def test_stages_carry_columns_of_any_name(spark, sf_dir, name):
    d = prepared(spark)
    got = STAGES[name](spark, d, sf_dir)
    rows = got.collect()
    assert got.columns == d.columns and rows
    assert all(r[c] == f"extra {c}" for r in rows for c in NAMES)


def test_operators_take_columns_of_any_name(spark, sf_dir):
    d = prepared(spark)
    labels = frame(spark, [(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    assert quality.scored(d, quality.train(d, labels)).count() == 6
    assert {r.doc_id for r in packing.packed(d, tokenizer_ranks()).collect()} == set(range(6))
    assert media.media_columns(d).count() == mixing.mix(d).count() == simhash.simhash_groups(d).count() == 6
    assert paragraphs.repeats(d).columns[0] == "doc_id" and linejoin.line_classes(d).count() == 18
    assert nearcopies.near_dedup(d).columns == d.columns
    taken = {"vec_id", "embedding", "page_id", "url", "html", "conv_id", "turn", "role"}
    more = [F.lit("x").alias(c) for c in NAMES if c not in taken]
    v = frame(spark, [(i, [float(i), 1.0]) for i in range(30)], "vec_id long, embedding array<double>").select("*", *more)
    assert topk.top_scores(v, k=3).count() == 6
    pages = frame(spark, [(1, "u", "h" * 1200), (2, "u", "h" * 1200), (None, None, None)], "page_id long, url string, html string").select("*", *more)
    assert sorted(r.record_type for r in warc.archive_pages(pages).collect()) == ["response", "response", "revisit"]
    turns = frame(spark, [(1, 0, "user", "q"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string").select("*", *more)
    assert preference.format_preferences(preference.stale_reply_pairs(turns)).count() == 1


def test_ids_beyond_floats_stay_beside_nulls(spark):
    ids = [None, *((1 << 53) + k for k in (1, 3, 5, 7))]
    got = packing.packed(frame(spark, [(i, f"some text {i}") for i in ids]), tokenizer_ranks()).collect()
    assert sorted((r.doc_id for r in got), key=lambda x: (x is not None, x)) == ids
    mixed = mixing.mix(frame(spark, [(i, "a b c", "s") for i in ids], "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id for r in mixed), key=lambda x: (x is not None, x)) == ids


def test_opening_bins_as_a_last_resort_takes_no_more_sequences():
    rng = np.random.default_rng(6)
    lengths = np.sort(np.minimum(2047, rng.lognormal(5.5, 1.1, 4000).astype(np.int64) + 1))[::-1]
    bins = [packing.sum_of_squares(lengths, 2048, weigh_opening=w)[0].max() + 1 for w in (False, True)]
    assert -(-lengths.sum() // 2048) <= bins[0] <= bins[1]


def test_lasso_is_optimal():
    rng = np.random.default_rng(3)
    r = (rng.random((600, 12)) < 0.4).astype(float)
    y = (rng.random(600) < 1 / (1 + np.exp(-(2 * r[:, 0] - 1.5 * r[:, 1] + 0.3)))).astype(float)
    penalty = 0.01
    b, w = quality.lasso(r, y, penalty, steps=4000)
    gradient = r.T @ (1 / (1 + np.exp(-(r @ w + b))) - y) / len(y)
    assert np.all(np.abs(gradient) <= penalty + 1e-5)
    assert np.allclose(gradient[w != 0], -penalty * np.sign(w[w != 0]), atol=1e-5)
    assert 0 < (w != 0).sum() < 12


def test_split_is_the_best_of_all():
    rng = np.random.default_rng(8)
    x, y = rng.random((200, 3)), (rng.random(200) < 0.5).astype(float)
    g, h = y - 0.5, np.full(200, 0.25)
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, 20)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    gain, k, at = quality._split(x, g, h, edges, binned, 5)
    part = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)
    every = [part(x[:, j] <= e) + part(x[:, j] > e) - part(x[:, j] > -1) for j in range(3) for e in edges[j] if min((x[:, j] <= e).sum(), (x[:, j] > e).sum()) >= 5]
    assert abs(gain - max(every)) < 1e-9 and abs(part(x[:, k] <= at) + part(x[:, k] > at) - part(x[:, k] > -1) - gain) < 1e-9


def test_lists_are_not_read_to_their_ends():
    rng = np.random.default_rng(2)
    v = np.floor(64 * rng.normal(0, 0.125, (3000, 64)))
    ids, share = np.arange(3000), []
    q, rows, scores = topk.block_top(v[::100], ids[::100], v, ids, 20, share)
    assert sum(a for a, _ in share) < 0.93 * sum(n for _, n in share)
    for i in range(30):
        s = v @ v[100 * i]
        s[100 * i] = -np.inf
        assert rows[q == i].tolist() == np.lexsort((ids, -s))[:20].tolist()


def test_a_hot_chunk_is_read_beside_the_others(spark, monkeypatch):
    monkeypatch.setattr(media, "HOT", 5)
    rng = random.Random(7)
    same = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    rows = [(i, same + f" end {i}") for i in range(40)] + [(100 + i, f"own text {i}") for i in range(5)]
    got = {r.doc_id: r for r in media.media_columns(frame(spark, rows)).collect()}
    assert {i: got[i].n_bytes for i, _ in rows} == {i: len(t) for i, t in rows}
