"""Golden values and properties of the kernels and scalar functions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.config import Config, InsertSize, ReadGroup, Scoring, preset
from strandline.functions import sequence as S
from strandline.operators import alignment as A
from strandline.operators.chaining import chain_matches

SC = Scoring()


def one(f, q, r, *a, **k):
    return f([A.codes(q)], [A.codes(r)], *a, **k)[0]


def score(a, q, r, sc=SC):
    """The score that a CIGAR has on its own, after checking that it consumes what it says."""
    i, j, total = 0, a.ref_begin, 0
    for op, n in a.cigar:
        if op in "=X":
            for k in range(n):
                same = q[i + k] == r[j + k] and q[i + k] != "N"
                assert same == (op == "=")
                total += sc.match if same else sc.mismatch
            i, j = i + n, j + n
        elif op == "I":
            i, total = i + n, total + sc.gap_open + n * sc.gap_ext
        elif op == "D":
            j, total = j + n, total + sc.gap_open + n * sc.gap_ext
        else:
            i += n
    assert i == len(q) and j == a.ref_end
    return total


def brute_local(q, r, sc=SC):
    m, n = len(q), len(r)
    h = np.zeros((m + 1, n + 1), int)
    e, f = np.full((m + 1, n + 1), -(10**6)), np.full((m + 1, n + 1), -(10**6))
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            e[i, j] = max(e[i, j - 1], h[i, j - 1] + sc.gap_open) + sc.gap_ext
            f[i, j] = max(f[i - 1, j], h[i - 1, j] + sc.gap_open) + sc.gap_ext
            s = sc.match if q[i - 1] == r[j - 1] and q[i - 1] != "N" else sc.mismatch
            h[i, j] = max(0, h[i - 1, j - 1] + s, e[i, j], f[i, j])
    return int(h.max())


def brute_global(q, r, sc=SC):
    low = -(10**6)
    m, n = len(q), len(r)
    h, e, f = (np.full((m + 1, n + 1), low) for _ in range(3))
    h[0, 0] = 0
    for i in range(m + 1):
        for j in range(n + 1):
            if j:
                e[i, j] = max(e[i, j - 1], h[i, j - 1] + sc.gap_open) + sc.gap_ext
            if i:
                f[i, j] = max(f[i - 1, j], h[i - 1, j] + sc.gap_open) + sc.gap_ext
            d = h[i - 1, j - 1] + (sc.match if q[i - 1] == r[j - 1] and q[i - 1] != "N" else sc.mismatch) if i and j else (0 if not i and not j else low)
            h[i, j] = max(d, e[i, j], f[i, j])
    return int(h[m, n])


def bases(rng, n, letters="ACGT"):
    return "".join(rng.choice(letters) for _ in range(n))


def mutated(rng, s, k):
    s = list(s)
    for _ in range(k):
        at, kind = rng.randrange(len(s)), rng.random()
        if kind < 0.5:
            s[at] = rng.choice("ACGT")
        elif kind < 0.75:
            s[at : at + rng.randint(1, 4)] = []
        else:
            s[at:at] = bases(rng, rng.randint(1, 4))
        if not s:
            return "A"
    return "".join(s)


def test_identical_global():
    a = one(A.align_global, "ACGTACGT", "ACGTACGT")
    assert (a.score, a.text()) == (8, "8=")


def test_global_mismatch_shows():
    assert "X" in one(A.align_global, "ACGTACGT", "ACGTTTGT").text()


def test_semi_global_place():
    a = one(A.semi_global, "ACGT", "AAACGTAA", SC, 10)
    assert (a.score, a.ref_begin, a.ref_end, a.query_begin, a.query_end) == (4, 2, 6, 0, 4)


def test_clipped_head():
    r = "GATTACAGGCTCATCCGGTCA"
    a = one(A.align_local, "A" * 19 + r, r)
    assert (a.score, a.query_begin, a.query_end, a.ref_begin, a.ref_end) == (21, 19, 40, 0, 21) and a.text() == "19S21="
    flanked = "C" * 20 + r + "T" * 20
    a = one(A.align_local, "G" * 19 + r, flanked)
    assert (a.ref_begin, a.ref_end, a.score) == (20, 41, 21)


@pytest.mark.parametrize("seed", range(4))
def test_local_equals_brute_force_and_its_own_cigar(seed):
    rng = random.Random(seed)
    qs = [bases(rng, rng.randint(1, 40), "ACGTN" if seed % 2 else "ACGT") for _ in range(60)]
    rs = [mutated(rng, q, rng.randint(0, 6)) if rng.random() < 0.7 else bases(rng, rng.randint(1, 50)) for q in qs]
    sc = Scoring(1, -1, -1, -1) if seed > 1 else SC
    for q, r, a in zip(qs, rs, A.align_local([A.codes(q) for q in qs], [A.codes(r) for r in rs], sc)):
        assert a.score == brute_local(q, r, sc)
        if a.score:
            assert score(a, q, r, sc) == a.score


def test_global_equals_brute_force():
    rng = random.Random(9)
    for _ in range(40):
        q = bases(rng, rng.randint(1, 25))
        r = mutated(rng, q, rng.randint(0, 5))
        a = one(A.align_global, q, r)
        assert a.score == brute_global(q, r) == score(a, q, r)


def test_banded_equals_full_where_the_band_suffices():
    rng = random.Random(1)
    qs = [bases(rng, 60) for _ in range(100)]
    rs = [mutated(rng, q, 4) for q in qs]
    full = A.align_local([A.codes(q) for q in qs], [A.codes(r) for r in rs])
    band = A.align_local([A.codes(q) for q in qs], [A.codes(r) for r in rs], SC, 30)
    assert [a.score for a in full] == [a.score for a in band]


def test_narrow_band_stays_within_and_scores_itself():
    rng = random.Random(2)
    for _ in range(60):
        q = bases(rng, 40)
        r = mutated(rng, q, 5)
        a = one(A.align_local, q, r, SC, 1)
        assert a.score <= brute_local(q, r) and (not a.score or score(a, q, r) == a.score)


def test_only_n_and_empty_score_nothing():
    assert one(A.align_local, "NNNN", "NNNN").score == 0
    assert one(A.align_local, "", "ACGT").score == 0 and one(A.align_local, "ACGT", "").text() == "*"


def test_unclip_takes_ends_that_cost_less_than_clipping():
    ref = "TTTTT" + "ACGGTCATTGACCAGTACAGGATCC" + "TTTTT"
    query = "G" + ref[6:29] + "A"
    a = one(A.semi_global, query, ref, SC, 20)
    assert (a.query_begin, a.query_end) == (0, len(query)) and a.text().startswith("1X") and a.score == score(a, query, ref)
    assert one(A.align_local, query, ref).query_begin == 1


def test_extend_gives_up_after_a_drop():
    a = "ACGTTGCAAC"
    q, r = a + "A" * 40 + "GGATCCGGATTC" * 2, a + "C" * 40 + "GGATCCGGATTC" * 2
    assert one(A.extend, q, r, SC, 60, 5).score == 10
    assert one(A.align_local, q, r).score == 24


def test_md_text():
    a = A.Alignment(0, 1, 8, 0, 8, (("=", 2), ("X", 1), ("D", 2), ("I", 3), ("=", 2)))
    assert A.md_text(a, A.codes("TACGTTAACC")) == "2G0^TT2"


def chains(rows, least=10, gap=10_000):
    q, r, n = (np.array(x) for x in zip(*rows)) if rows else (np.zeros(0, int),) * 3
    return chain_matches(q, r, n, gap, least)


def test_chain_golden_values():
    c = chains([(0, 100, 10), (12, 112, 10)])
    assert [(x.score, len(x.members)) for x in c] == [(18, 2)]
    c = chains([(0, 0, 10), (10, 10, 10), (20, 100, 10)], 5)
    assert [(x.score, len(x.members)) for x in c] == [(20, 2), (10, 1)]
    assert [x.score for x in chains([(0, 0, 10), (5, 5, 10)], 5)] == [10, 10]
    assert chains([]) == []


def test_chain_paths_are_colinear_and_disjoint():
    rng = random.Random(3)
    for _ in range(50):
        rows = [(rng.randrange(100), rng.randrange(100), rng.randint(5, 15)) for _ in range(12)]
        found, seen = chains(rows, 5), set()
        for c in found:
            assert not seen & set(c.members)
            seen |= set(c.members)
            for a, b in zip(c.members, c.members[1:]):
                assert rows[b][0] >= rows[a][0] + rows[a][2] and rows[b][1] >= rows[a][1] + rows[a][2]


@pytest.mark.parametrize(
    "score, sub, csub, sub_n, span, k, want",
    [(20, 0, 0, 0, 20, 9, 60), (20, 0, 0, 0, 20, 19, 6), (20, 20, 0, 0, 20, 9, 0), (100, 90, 0, 0, 100, 9, 43), (100, 90, 0, 1, 100, 9, 40), (30, 0, 0, 0, 100, 9, None), (0, 0, 0, 0, 0, 9, 0)],
)
def test_mapq_golden_values(spark, score, sub, csub, sub_n, span, k, want):
    got = spark.range(1).select(S.mapq(F.lit(score), F.lit(sub), F.lit(csub), F.lit(sub_n), F.lit(span), F.lit(span), min_seed_len=k)).first()[0]
    assert 0 <= got <= 60 and (want is None or got == want)


def test_cigar_and_sequence_functions(spark):
    row = spark.createDataFrame([("3S5=2D1X4I7=", "ACGTNacgt")], "c string, s string").select(
        S.format_cigar(S.parse_cigar("c")).alias("back"), S.reference_span(S.parse_cigar("c")).alias("r"), S.query_span(S.parse_cigar("c")).alias("q"), S.edit_count(S.parse_cigar("c")).alias("nm"), S.encode("s").alias("codes"), S.reverse_complement("s").alias("rc"), S.wrapped("s", 4).alias("w")
    ).first()
    assert (row.back, row.r, row.q, row.nm) == ("3S5=2D1X4I7=", 15, 17, 7)
    assert (row.codes, row.rc, row.w) == ("012340123", "ACGTNACGT", "ACGT\nNacg\nt\n")


def test_sql_functions(spark):
    S.register(spark)
    row = spark.sql("SELECT reverse_complement('AACG') r, reg2bin(100, 200) b, cigar_ref_span('5=2D3I4X') s").first()
    assert (row.r, row.b, row.s) == ("CGTT", 4681, 11)


def test_presets_and_options():
    assert [preset(x).min_seed_len for x in ("ont2d", "ont", "nanopore", "pacbio", "ccs", "intractable", "sr", "fast")] == [14, 14, 14, 17, 17, 19, 19, 23]
    with pytest.raises(ValueError):
        preset("bogus")
    assert Config().max_alignments == 4 and preset("fast").max_alignments == 3
    assert ReadGroup.parse("@RG\\tID:a\\tSM:b").sample == "b"
    with pytest.raises(ValueError):
        ReadGroup.parse("@RG\\tSM:b")
    assert InsertSize.parse("300") == InsertSize(300, 30, 420, True) and InsertSize.parse("300,20,500,1").max_window == 500
    for bad in ("", "x", "-3", "1,2,3,4,5"):
        with pytest.raises(ValueError):
            InsertSize.parse(bad)


def test_sizes_round_ties_as_printf_does(spark):
    sizes = [0, 1023, 1152, 1408, 1664, 2176, (1 << 20) - 1, (5 << 20) + (1 << 17), (7 << 30) + (5 << 27), (3 << 40) + (1 << 37), (3 << 40) + (1 << 37) + 1, (1 << 63) - 1]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", S.format_bytes("n").alias("s")).collect()
    for n, s in got:
        k = max(0, (n.bit_length() - 1) // 10) if n < 1 << 40 else 4
        assert s == (f"{n} B" if not k else f"{n / (1 << 10 * k):.2f} {['', 'KB', 'MB', 'GB', 'TB'][k]}")


def test_bins_of_ranges_across_large_windows(spark):
    ends = [(0, 1, 4681), (16380, 16390, 585), (131062, 131085, 73), ((1 << 20) - 5, (1 << 20) + 5, 9), ((1 << 23) - 5, (1 << 23) + 5, 1), ((1 << 26) - 5, (1 << 26) + 5, 0)]
    got = spark.createDataFrame(ends, "b long, e long, want int").select("want", S.reg2bin("b", "e").alias("bin")).collect()
    assert all(r.want == r.bin for r in got)
