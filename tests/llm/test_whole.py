"""That operators do the whole of their job: cases that cuts used to leave out."""

import random
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import forest, nearcopies, paragraphs, simhash
from strandline.llm.components import components
from strandline.llm.queries import op7_lines

from test_near import DOCS, closure, frame, prose


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_near_copy_stage_finds_all_pairs_of_similarity(spark):
    rng = random.Random(17)
    rows = []
    for g in range(40):
        w = prose(rng, rng.randint(60, 300), 3000)
        for k in range(3):
            x = list(w)
            for _ in range(rng.randint(0, 1 + len(w) // 60)):
                x[rng.randrange(len(x))] = f"new{rng.randrange(10**6)}"
            rows.append((10 * g + k, " ".join(x), "en", "a", 1))
    rows += [(900, None, None, None, None), (901, " \n", "en", "a", 2), (902, "Two words", "en", "a", 9), (903, "two words", "en", "a", 9), (904, "two others", "en", "a", 9)]
    sets = {i: shingles(t) for i, t, *_ in rows}
    near = [(a, b) for a, b in combinations(sets, 2) if jaccard(sets[a], sets[b]) >= 0.8]
    prints = {i: simhash.fingerprint(t or "") for i, t, *_ in rows}
    assert sum((prints[a] ^ prints[b]).bit_count() > 3 for a, b in near) >= 10  # which the radius of op9 does not reach
    want = sorted(set(closure(sorted(sets), near).values()))
    got = corpus_pipeline.drop_near_copies(spark, frame(spark, rows, DOCS), None)
    assert sorted(r.doc_id for r in got.collect()) == want


def test_similarity_of_whole_texts_is_exact_in_slices(monkeypatch):
    monkeypatch.setattr(paragraphs, "CELLS", 64)
    rng = np.random.default_rng(1)
    base = rng.choice(10**6, 300, replace=False)
    sets = [np.unique(np.r_[base[: 300 - k], rng.choice(10**6, k)]).astype(np.uint64) for k in (0, 10, 20, 34, 60, 200)]
    want = [[jaccard(set(a.tolist()), set(b.tolist())) >= 0.8 for b in sets] for a in sets]
    assert nearcopies.alike(pa.table({"grams": [s.tobytes() for s in sets]})).tolist() == want


def test_short_lines_are_classed_by_equality(spark, tmp_path):
    long = "a line that is long enough for the edit join"
    rows = [(1, f"Les.\n{long}\n\nLes", "en", "s", 1), (2, f"Les.\n{long}!\n\nown", "en", "s", 1), (3, " Les. \nx", "en", "s", 1), (4, "Les.", "en", "s", 4)]
    frame(spark, rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    got = op7_lines(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.line_no) for r in got if r.removed) == [(2, 0), (2, 1), (3, 0), (4, 0)]
    assert all((r.kept_doc_id, r.kept_line_no) == (1, r.line_no) for r in got if r.removed)
    assert sorted((r.doc_id, r.line_no) for r in got if r.class_id is None) == [(1, 2), (2, 2)]
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_lines(spark, frame(spark, rows, DOCS), None).collect()}
    assert out == {1: rows[0][1], 2: "\nown", 3: "x"}


def test_near_copies_meet_by_their_fingerprints(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(60):  # pairs that differ in one run of words, at a similarity from 0.8 on
        a = [rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randrange(500)) for _ in range(rng.randrange(120, 400))]
        at = rng.randrange(len(a) - 10)
        texts += [" ".join(a), " ".join(a[:at] + ["new"] * rng.randrange(1, len(a) // 20) + a[at + 1 :])]
    near = {i for i in range(0, 120, 2) if jaccard(shingles(texts[i]), shingles(texts[i + 1])) >= 0.8}
    assert len(near) > 50
    g = nearcopies.shingle_set(texts[0])
    word = nearcopies.blend(g * nearcopies.SCALE[3] + nearcopies.SHIFT[3])
    bits = [2 * sum(int(x) >> i & 1 for x in word) > len(g) for i in range(64)]
    assert int(nearcopies.fingerprint(g)[3]) == sum(1 << i for i, b in enumerate(bits) if b)
    rows = spark.createDataFrame(list(enumerate(texts)), "row_ long, text string")
    found = nearcopies.sketches(rows)
    at = {r.node: r.row_ for r in found.select("row_", "node").collect()}
    got = {min(at[r.u], at[r.v]) for r in nearcopies.met(found).collect()}
    assert near <= got and len(got) <= 60


def test_small_blocks_are_linked_as_large_ones_are(spark):
    rng = random.Random(5)
    members = [(b, i, rng.randrange(64)) for b in range(60) for i in rng.sample(range(4000), rng.randrange(1, 40))]
    close = lambda t, i, j: abs(t["x"].to_numpy()[i] - t["x"].to_numpy()[j]) <= 2
    df = spark.createDataFrame(members, "bucket long, id long, x long")
    near = lambda t: close(t, np.arange(len(t))[:, None], np.arange(len(t))[None, :])
    for b in range(0, 60, 20):
        some = df.where(f"bucket between {b} and {b + 19}").withColumn("id", F.col("bucket") * 10_000 + F.col("id"))
        a, c = ({(r.node, r.label) for r in components(forest.bucket_links(some, near, close=x)).collect()} for x in (None, close))
        assert a == c and a
