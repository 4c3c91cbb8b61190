"""SimHash, components, forests, paragraphs and lines against brute force."""

import random
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from strandline.llm import forest, linejoin, paragraphs, simhash
from strandline.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def closure(nodes, near):
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in near:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


@lru_cache
def vocabulary(words):
    rng = random.Random(words)
    return ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(words)]


def prose(rng, n, words=400):
    return [rng.choice(vocabulary(words)) for _ in range(n)]


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", low)]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", ["", " \t", "One", "ÉTÉ A b", "a b c d\x0be f", "x " * 200_000, "A\xa0B c d"])
def test_fingerprint_is_as_defined(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_spark_hash_is_the_same_function(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("été the x"))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest("été the x".encode(), 42)


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    rows, base = [], [prose(rng, 60) for _ in range(12)]
    for i in range(220):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = rng.choice("pqrs") * 3
        rows.append((i + 5, " ".join(w)))
    rows += [(1, None), (2, ""), (None, " "), (300, " ".join(base[0])), (300, " ".join(base[0]))]
    got = simhash.simhash_groups(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    fps = {}
    for i, t in rows:
        fps.setdefault(brute_fingerprint(t), []).append(i)
    near = [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    label = closure(fps, near)
    first = {}
    for f, ids in fps.items():
        known = [i for i in ids if i is not None]
        first[label[f]] = min([first.get(label[f], 10**9), *known])
    want = sorted((str(i), brute_fingerprint(t), first[label[brute_fingerprint(t)]]) for i, t in rows)
    assert sorted((str(r.doc_id), r.fp % (1 << 64), r.component_id) for r in got) == want


def test_near_dedup_keeps_one_of_each_group(spark):
    text = " ".join(prose(random.Random(1), 50))
    rows = [(4, text, "en", "a", 1), (3, text, "en", "a", 1), (3, text, "en", "a", 1), (9, "quite another text", None, None, None), (None, None, None, None, None)]
    out = simhash.near_dedup(frame(spark, rows, DOCS))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("3", text), ("9", "quite another text"), ("None", None)])
    assert simhash.near_dedup(frame(spark, [], DOCS)).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = random.Random(5)
    ids = rng.sample(range(10**6), 200)
    edges = list(zip(ids[:90], ids[1:90])) + [(ids[100], x) for x in ids[101:150]] + [(ids[160], ids[160]), (ids[3], ids[4]), (None, 5)]
    got = {r.node: r.label for r in components(frame(spark, edges, "u long, v long")).collect()}
    want = closure({x for e in edges if None not in e and e[0] != e[1] for x in e}, [e for e in edges if None not in e and e[0] != e[1]])
    assert got == want
    assert components(frame(spark, [], "u long, v long")).count() == 0


def test_forest_connects_as_all_pairs_do_and_stays_small(spark):
    rng = np.random.default_rng(2)
    values = rng.integers(0, 1 << 40, 500).tolist()
    rows = [(v % 2, v) for v in set(values)]
    near = lambda t: np.bitwise_count((x := t["id"].to_numpy().view(np.uint64))[:, None] ^ x[None, :]) <= 12
    got = forest.bucket_links(frame(spark, rows, "bucket long, id long"), near, chunk=32).collect()
    true = [(a, b) for (k, a), (m, b) in combinations(rows, 2) if k == m and (a ^ b).bit_count() <= 12]
    nodes = [v for _, v in rows]
    assert closure(nodes, [(r.u, r.v) for r in got]) == closure(nodes, true)
    assert {(min(r.u, r.v), max(r.u, r.v)) for r in got} <= {(min(e), max(e)) for e in true}


def test_spanning_forest_of_a_clique_is_linear():
    assert len(forest.spanning(np.ones((50, 50), bool))) == 49


def test_paragraph_words_and_hashes():
    w = paragraphs.Words("One two. Three\nfour  ONE")
    assert w.n == 5 and w.hash[0] == w.hash[4] and len(set(w.hash.tolist())) == 4
    assert paragraphs.Words("").n == 0 and paragraphs.Words(" \n ").n == 0


def test_passages_are_found_wherever_they_stand(spark):
    rng = random.Random(11)

    def sentences(n):
        out = []
        while len(out) < n:
            s = prose(rng, rng.randint(5, 12), 3000)
            out += s[:-1] + [s[-1] + "."]
        return out[:n]

    passages = [sentences(rng.randint(75, 120)) for _ in range(30)]
    rows, inside = [], {}
    for i in range(60):
        w = sentences(rng.randint(150, 400))
        at = rng.randrange(len(w))
        rows.append((i, " ".join(w[:at] + passages[i % 30] + w[at:])))
    rows += [(1000 + i, " ".join(sentences(300))) for i in range(40)]
    rows += [(2000, None), (2001, ""), (2002, "too short"), (None, "also short")]
    got = paragraphs.repeats(frame(spark, rows)).collect()
    inside = {}
    for r in got:
        inside.setdefault(r.class_id, set()).add(r.doc_id)
    found = {frozenset(x) for x in inside.values()}
    assert sum(frozenset((i, i + 30)) in found for i in range(30)) >= 29
    assert all(r.doc_id < 60 for r in got)
    for c in {r.class_id for r in got}:
        assert sum(not r.removed for r in got if r.class_id == c) == 1
        assert len({r.kept_doc_id for r in got if r.class_id == c}) == 1


def test_paragraphs_cover_every_word_and_keep_apart():
    rng = random.Random(3)
    for n in [*range(18, 90), 500, 4000]:
        w = paragraphs.Words(" ".join(prose(rng, n, 60)))
        at = paragraphs.paragraphs(w).tolist()
        if n < paragraphs.LEAST:
            assert at == []
            continue
        assert at[0] == 0 and at[-1] == max(0, n - paragraphs.WORDS)
        assert all(0 < b - a <= paragraphs.WORDS for a, b in zip(at, at[1:]))
        assert all(b - a > paragraphs.NEAR for a, b in zip(at, at[1:])) or n <= paragraphs.WORDS + paragraphs.NEAR


def test_passages_of_51_words_share_an_alike_paragraph():
    """Of drawn pairs of texts that share a run of words, nearly all hold paragraphs that the bands bring together."""
    rng = random.Random(5)
    for size, least in ((51, 0.985), (60, 0.99), (75, 0.995)):
        hit = 0
        for _ in range(400):
            run, sides = prose(rng, size, 4000), []
            for _ in range(2):
                w = paragraphs.Words(" ".join(prose(rng, rng.randint(0, 200), 4000) + run + prose(rng, rng.randint(0, 200), 4000)))
                at = paragraphs.paragraphs(w)
                sides.append((w, at, paragraphs.band_keys(w, at, paragraphs.WORDS)[1]))
            (v, a, x), (w, b, y) = sides
            meet = [(i, j) for i in range(len(a)) for j in range(len(b)) if (x[i] == y[j]).any()]
            sets = lambda w, at: set(w.grams(5)[at : at + paragraphs.WORDS - 4].tolist())
            near = lambda p, q: len(p & q) >= 0.8 * len(p | q)
            hit += any(near(sets(v, a[i]), sets(w, b[j])) for i, j in meet)
        assert hit >= least * 400, (size, hit)


def test_repeats_within_one_document_are_reported(spark):
    rng = random.Random(21)
    run = prose(rng, 80, 4000)
    text = " ".join(prose(rng, 70, 4000) + run + prose(rng, 90, 4000) + run + prose(rng, 40, 4000))
    again = " ".join(["la"] * 100)  # overlaps itself at every place
    got = paragraphs.repeats(frame(spark, [(1, text), (1, text), (2, " ".join(prose(rng, 300, 4000))), (3, again)])).collect()
    mine = [r for r in got if r.doc_id == 1]
    assert {r.doc_id for r in got} <= {1, 3} and any(r.removed for r in mine)
    assert all(240 <= r.start_word < 320 for r in mine if r.removed) and all(r.start_word < 150 for r in mine if not r.removed)


def test_paragraph_classes_match_brute_jaccard(spark):
    rng = random.Random(8)
    base = [prose(rng, 24, 2000) for _ in range(20)]
    rows = []
    for i in range(120):
        w = list(base[i % 20])
        for _ in range(rng.choice([0, 0, 1])):
            w[rng.choice([0, len(w) - 1])] = rng.choice(["aa", "bb", "cc"])
        rows.append((i, " ".join(w)))
    grams = [set(zip(*(t.split()[k:] for k in range(5)))) for _, t in rows]
    true = [(a, b) for a, b in combinations(range(120), 2) if len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b])]
    want = closure(range(120), true)
    got = paragraphs.repeats(frame(spark, rows)).collect()
    label = {}
    for r in got:
        label.setdefault(r.class_id, set()).add(r.doc_id)
    pairs = {p for c in label.values() for p in combinations(sorted(c), 2)}
    truth = {(a, b) for a, b in combinations(range(120), 2) if want[a] == want[b]}
    assert pairs <= truth and len(pairs) >= 0.98 * len(truth)


def test_alike_is_exact_jaccard():
    a, b = np.arange(10, dtype=np.uint64), np.arange(1, 11, dtype=np.uint64)
    t = pa.table({"grams": [a.tobytes(), b.tobytes(), a[:5].tobytes()]})
    assert paragraphs.alike(t, 0.8).tolist() == [[True, True, False], [True, True, False], [False, False, True]]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, k):
    s = list(s)
    for _ in range(k):
        at, kind = rng.randrange(len(s) + 1), rng.randrange(3)
        if kind == 0:
            s.insert(at, rng.choice("abcé "))
        elif s and kind == 1:
            s.pop(min(at, len(s) - 1))
        elif s:
            s[min(at, len(s) - 1)] = rng.choice("abcé ")
    return "".join(s)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_bit_parallel_distance_is_exact(spark, edits):
    rng = random.Random(edits)
    rows = []
    for i in range(300):
        a = "".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 40)))
        rows.append((i, a, edited(rng, a, rng.randint(0, 5))))
    rows += [(900, "", ""), (901, "a", ""), (902, "abc", "cba")]
    got = {r.i for r in linejoin.within_edits(frame(spark, rows, "i int, a string, b string"), edits).collect()}
    assert got == {i for i, a, b in rows if levenshtein(a, b) <= edits}


def test_character_counts_never_part_near_lines(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = []
    for _ in range(400):
        a = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz é") for _ in range(rng.randint(0, 90)))
        b = edited(rng, a, rng.randint(0, 4)) if rng.random() < 0.8 else "".join(rng.choice("abé ") for _ in range(rng.randint(0, 90)))
        rows.append((a, b))
    near = linejoin.counts_near(linejoin.char_counts(F.col("a")), linejoin.char_counts(F.col("b")), 2)
    for r in frame(spark, rows, "a string, b string").select("a", "b", near.alias("near")).collect():
        count = lambda t: [sum(ord(c) % linejoin.FIELDS == k for c in t) for k in range(linejoin.FIELDS)]
        d = [abs(x - y) for x, y in zip(count(r.a), count(r.b))]
        assert r.near or sum(d) > 4
        assert not r.near or sum(d) <= 4 or max(d) > 7


@pytest.mark.parametrize("edits", [1, 2])
def test_line_classes_match_brute_force(spark, edits):
    rng = random.Random(20 + edits)
    base = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(22, 60))).strip() + "." for _ in range(40)]
    rows = []
    for i in range(60):
        lines = [edited(rng, rng.choice(base), rng.choice([0, 0, 1, 2, 3])) for _ in range(5)] + ["short"]
        rows.append((i, "\n".join(lines)))
    rows += [(70, None), (71, ""), (None, base[0]), (5, rows[5][1])]
    got = linejoin.line_classes(frame(spark, rows), edits).collect()
    assert len(got) == sum(len((t or "").split("\n")) for _, t in rows)
    lines = {x.strip(" \t\r") for _, t in rows for x in (t or "").split("\n")}
    lines = sorted(x for x in lines if len(x) >= linejoin.LEAST)
    want = closure(lines, [(a, b) for a, b in combinations(lines, 2) if levenshtein(a, b) <= edits])
    text = {(i, k): x.strip(" \t\r") for i, t in rows for k, x in enumerate((t or "").split("\n"))}
    classes, mine = {}, {}
    for r in got:
        if r.class_id is None:
            assert not r.removed and len(text[r.doc_id, r.line_no]) < linejoin.LEAST
            continue
        classes.setdefault(r.class_id, set()).add((r.doc_id, r.line_no))
        mine.setdefault(want[text[r.doc_id, r.line_no]], set()).add((r.doc_id, r.line_no))
    assert {frozenset(x) for x in classes.values()} == {frozenset(x) for x in mine.values()}
    order = lambda p: (-1 if p[0] is None else p[0], p[1])
    for r in got:
        if r.class_id is not None:
            keep = min(classes[r.class_id], key=order)
            assert (r.kept_doc_id, r.kept_line_no) == keep
            assert r.removed == ((r.doc_id, r.line_no) != keep)


def test_repeated_lines_go_and_clean_documents_stay(spark):
    a, b = "a line that is long enough to count", "another line that is quite different"
    rows = [(1, f"{a}\n{b}", "en", "s", 72), (2, f"own words here, which nobody repeats\n{a}!", "en", "s", 73), (3, b, None, None, 36), (4, None, None, None, None), (5, "", "x", "y", 0), (6, "short\nshort", "x", "y", 11)]
    out = {r.doc_id: r for r in linejoin.drop_repeated_lines(frame(spark, rows, DOCS)).collect()}
    assert out[1].text == f"{a}\n{b}" and out[2].text == "own words here, which nobody repeats" and out[2].n_chars == 36
    assert set(out) == {1, 2, 4, 5, 6} and out[4].text is None and out[6].text == "short\nshort"
    assert linejoin.drop_repeated_lines(frame(spark, [], DOCS)).count() == 0


def test_operators_ignore_extra_columns_with_clashing_names(spark):
    from pyspark.sql import functions as F

    d = frame(spark, [(1, "some words of a text that is here " * 6), (2, "some words of a text that is here " * 6)])
    for c in ("fp", "id", "n", "key", "node", "line", "bucket", "label", "row_hash", "class_id", "words", "start"):
        d = d.withColumn(c, F.lit(1))
    assert simhash.simhash_groups(d).count() == 2
    assert linejoin.line_classes(d).count() == 2
    assert paragraphs.repeats(d).where("removed").count() >= 1
    assert simhash.near_dedup(d).columns == d.columns
    assert linejoin.drop_repeated_lines(d).columns == d.columns
