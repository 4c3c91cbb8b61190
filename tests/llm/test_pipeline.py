"""The pipeline against a brute-force version of its stages, and the registered queries."""

import zlib
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import linejoin, mixing, packing, quality
from strandline.llm.common import kept, table
from strandline.llm.queries import ORACLES, QUERIES, tokenizer_ranks

from test_near import closure, levenshtein
from test_operators import brute_targets
from test_whole import jaccard, shingles

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark, sf_dir, tmp_path_factory):
    """What each stage got and returned, written and read again as the pipeline does."""
    docs, out = table(spark, sf_dir, "documents"), []
    for name, f in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        f(spark, docs, sf_dir).write.parquet(path)
        got = spark.read.parquet(path)
        out.append((docs, got))
        docs = got
    return out


def rows(df):
    return [(r.doc_id, r.text, r.source) for r in df.collect()]


def test_all_stages_but_the_last_return_the_columns_of_documents(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "near_copies", "mixing", "packing"]
    assert all(got.columns == COLUMNS for _, got in steps[:-1])
    assert all(got.count() for _, got in steps)


def test_quality_stage_follows_the_scores(spark, sf_dir, steps):
    docs, got = steps[0]
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scores = {r.doc_id: r.score for r in quality.scored(docs, model).collect()}
    assert {r[0] for r in rows(got)} == {i for i, s in scores.items() if s >= 0.3}


def test_line_stage_drops_what_brute_force_drops(steps):
    docs, got = steps[1]
    before = sorted(rows(docs), key=lambda r: r[0])
    lines = {x.strip(" \t\r") for _, t, _ in before for x in (t or "").split("\n")}
    lines = sorted(x for x in lines if len(x) >= linejoin.LEAST)
    by_size = defaultdict(list)
    for x in lines:
        by_size[len(x)].append(x)

    def near(a, b):
        # Counts of characters tell most pairs apart.
        return sum(abs(v) for v in (Counter(a) - Counter(b)).values()) <= 2 and sum((Counter(b) - Counter(a)).values()) <= 2 and levenshtein(a, b) <= 2

    links = [(a, b) for a in lines for d in (0, 1, 2) for b in by_size[len(a) + d] if (d or a < b) and near(a, b)]
    label, seen, want = closure(lines, links), set(), {}
    # Lines too short for the edit join are classed by equality.
    label |= {x: ("short", x) for _, t, _ in before for y in (t or "").split("\n") if 0 < len(x := y.strip(" \t\r")) < linejoin.LEAST}
    for i, t, _ in before:
        keep, gone = [], False
        for x in (t or "").split("\n"):
            c = label.get(x.strip(" \t\r"))
            if c is not None and c in seen:
                gone = True
                continue
            if c is not None:
                seen.add(c)
            keep.append(x)
        if not gone or "".join(keep).strip(" \t\r\n"):
            want[i] = t if not gone else "\n".join(keep)
    assert {i: t for i, t, _ in rows(got)} == want


def test_near_copy_stage_keeps_one_of_each_group(steps):
    docs, got = steps[2]
    sets = {i: shingles(t) for i, t, _ in rows(docs)}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])) and jaccard(sets[a], sets[b]) >= 0.8]
    assert sorted(r[0] for r in rows(got)) == sorted(set(closure(sorted(sets), near).values()))


def test_mixing_stage_meets_its_targets(steps):
    docs, got = steps[3]
    sizes, words = Counter(), Counter()
    for _, t, s in rows(docs):
        sizes[s] += len((t or "").split())
    texts = {i: t for i, t, _ in rows(docs)}
    for i, t, s in rows(got):
        words[s] += len(t.split())
        assert texts[i].startswith(t) if len(t) < len(texts[i]) else t == texts[i]
    for s, target in brute_targets(sizes).items():
        assert abs(words[s] - target) <= 1


def test_packing_stage_holds_every_piece(steps):
    docs, got = steps[4]
    want = Counter()
    for i, t, _ in rows(docs):
        ids = packing.token_ids(t, tokenizer_ranks())
        for k, (a, n) in enumerate(packing.cuts(len(ids), packing.CAPACITY)):
            want[i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == want
    ends = {r.sequence_id: r.n for r in got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    assert max(ends.values()) <= packing.CAPACITY


def test_run_applies_the_stages(spark, sf_dir, steps):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a = Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).select(cols).collect())
    assert a == Counter(tuple(r) for r in steps[-1][1].select(cols).collect())


def test_every_stage_takes_an_empty_table_and_nulls(spark, sf_dir):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "x " * 50_000, "en", None, 100_000), (2, "x " * 50_000, "en", None, 100_000)]
    for some in ([], odd):
        for name, f in corpus_pipeline.STAGES:
            got = f(spark, spark.createDataFrame(some, schema), sf_dir)
            assert got.count() >= 0 and (name == "packing" or got.columns == COLUMNS)


def test_kept_is_a_filter(spark):
    df = spark.range(10).withColumn("x", F.when(F.col("id") > 3, F.col("id")))
    assert [r.id for r in kept(df, F.col("x") % 2 == 0).orderBy("id").collect()] == [4, 6, 8]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    from oracle import connection, difference

    assert difference(QUERIES[name](spark, sf_dir), connection(sf_dir), ORACLES[name]) == ""


def test_one_query_for_each_operator():
    assert [k.split("_")[0] for k in QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_contract_columns(spark, sf_dir):
    want = {
        "op1_quality": ["doc_id", "held_out", "score", "predicted"],
        "op2_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
        "op3_media": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        "op4_mixing": ["doc_id", "size", "source_size", "target", "taken"],
        "op8_topk": ["query_id", "rank", "vec_id", "score"],
        "op9_simhash": ["doc_id", "fingerprint", "component_id"],
        "op10_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    }
    for name, cols in want.items():
        assert set(cols) <= set(QUERIES[name](spark, sf_dir).columns)
    r = QUERIES["op9_simhash"](spark, sf_dir).first()
    assert len(r.fingerprint) == 16 and r.fingerprint == r.fingerprint.lower()


def test_mixing_operator_is_rerun_alike(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    a, b = (Counter((r.doc_id, r.taken) for r in mixing.mix(x).collect()) for x in (d, d.repartition(5)))
    assert a == b
