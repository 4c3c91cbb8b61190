"""Quality, packing, media, mixing, preferences, top-k and WARC."""

import gzip
import hashlib
import io
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strandline.llm import media, mixing, packing, preference, quality, topk, warc
from strandline.llm.common import new_path
from strandline.llm.queries import tokenizer_ranks

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = ["", " ", "\n\n", "word", "<|endoftext|> in a text", "été \U0001f600 漢字\t\x00", "a" * 5000, "don't  stop\r\n 12345 !!", " leading", "trailing  \n "]


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


# Quality


def texts(rng, n):
    out = []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 80))]
        good = rng.random() < 0.8
        out.append((i, " ".join(words) if good else rng.choice([" | ".join(words), " ".join([words[0]] * 60), " ".join(w + "***" for w in words), " ".join(words).upper() + "!!"]), int(good)))
    return out


def test_quality_separates_held_out_rows(spark):
    rows = texts(random.Random(1), 1500)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    labels = frame(spark, [(i, q, 0) for i, _, q in rows] + [(99_999, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert 0 < len(model.rules) < 200
    scored = quality.scored(docs, model).collect()
    assert all(0 <= r.score <= 1 for r in scored)
    truth = {i: q for i, _, q in rows}
    held = [r for r in scored if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert np.mean([(r.score >= 0.3) == truth[r.doc_id] for r in held]) > 0.95
    x = np.array([r.stats for r in scored])
    assert np.allclose(model.score(x), [r.score for r in scored])
    again = quality.train(docs, labels)
    assert again.rules == model.rules and again.weights == model.weights


def test_quality_never_learns_from_held_out_labels(spark):
    rows = texts(random.Random(2), 400)
    docs = frame(spark, [(i, t) for i, t, _ in rows])
    flip = lambda i, q: 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q
    a = quality.train(docs, frame(spark, [(i, q) for i, _, q in rows], "doc_id long, quality int"))
    b = quality.train(docs, frame(spark, [(i, flip(i, q)) for i, _, q in rows], "doc_id long, quality int"))
    assert a.weights == b.weights and a.bias == b.bias


def test_quality_of_odd_rows(spark):
    odd = [(None, None), (1, ""), (1, ""), (2, "\n"), (3, "x" * 300_000)]
    none = quality.train(frame(spark, odd), frame(spark, [], "doc_id long, quality int"))
    rows = quality.scored(frame(spark, odd), none).collect()
    assert len(rows) == 5 and all(r.score == 0.5 for r in rows)
    assert quality.scored(frame(spark, []), none).count() == 0


def test_statistics_are_as_named(spark):
    r = quality.statistics(frame(spark, [(1, "Aa bb|bb, cc!\nAa 1 #.")])).first()
    s = dict(zip(quality.NAMES, r.stats))
    assert (s["words"], s["distinct_share"], s["words_a_line"], s["bars"], s["bangs"], s["symbols"], s["upper"], s["repeats"]) == (6, 5 / 6, 3, 1, 1, 1, 2, 1)
    assert s["digit_share"] == 1 / 21 and s["commas_share"] == 1 / 6


# Packing


def test_token_ids_equal_the_reference_tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for x in ODD:
        assert packing.token_ids(x, tokenizer_ranks()).tolist() == t.encode(x, add_special_tokens=False).ids + [0]


@pytest.mark.parametrize("n, want", [(1, [(0, 1)]), (8, [(0, 8)]), (9, [(0, 1), (1, 8)]), (16, [(0, 8), (8, 8)]), (19, [(0, 3), (3, 8), (11, 8)])])
def test_cuts(n, want):
    assert packing.cuts(n, 8) == want


def cost(used, capacity):
    return sum(v * v for v in Counter(capacity - u for u in used.values() if u < capacity).values())


def test_every_placement_is_least_in_the_sum_of_squares():
    rng, capacity, used = random.Random(4), 20, {}
    lengths = np.array([rng.randint(1, 19) for _ in range(200)])
    bins, offsets = packing.sum_of_squares(lengths, capacity)
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        room = [x for x, u in used.items() if u + s <= capacity]
        choices = [used | {x: used.get(x, 0) + s} for x in room or [b]]
        assert bool(room) == (b in used)
        assert used.get(b, 0) == o
        used[b] = o + s
        assert cost(used, capacity) == min(cost(c, capacity) for c in choices)


def test_packed_sequences_are_whole_and_gapless(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "δέλτα"]) for _ in range(rng.choice([3, 40, 200, 900, 4000])))) for i in range(150)]
    rows += [(500 + k, x) for k, x in enumerate(ODD)] + [(None, None), (7, ""), (7, "")]
    got = packing.packed(frame(spark, rows), tokenizer_ranks()).collect()
    want = Counter()
    for i, t in rows:
        ids = packing.token_ids(t or "", tokenizer_ranks())
        for k, (a, n) in enumerate(packing.cuts(len(ids), 2048)):
            want[i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r.sequence_id].append((r.offset, r.length))
    for p in places.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 2048
    least = math.ceil(sum(r.length for r in got) / 2048)
    assert len(places) <= least + 2
    assert packing.packed(frame(spark, []), tokenizer_ranks()).count() == 0


# Media


def test_media_round_trip(spark):
    rng = random.Random(9)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz \n") for _ in range(200_000))
    rows = [(k, x) for k, x in enumerate(ODD)] + [(50, long), (51, "x" + long), (52, long), (None, None), (53, long), (53, long)]
    got = media.media_columns(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    for i, t in rows:
        data = (t or "").encode()
        whole = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = by[i][0]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]))
        assert (r.media_bytes, r.media_sha256) == (len(media.encode(data)), hashlib.sha256(media.encode(data)).hexdigest())
        assert r.feature == media.feature(whole)
    assert media.media_columns(frame(spark, [])).count() == 0


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 300_000, dtype=np.uint8).tobytes()
    a, b = media.chunks(data), media.chunks(data[:1000] + b"inserted" + data[1000:])
    assert b"".join(a) == data and len(a) > 20
    assert len(set(a) & set(b)) >= len(a) - 4
    assert all(len(c) <= media.MOST for c in a) and all(len(c) >= media.LEAST for c in a[:-1])
    assert media.chunks(b"") == [] and media.chunks(b"z" * 100_000)[0] == b"z" * media.MOST
    h = 0
    for p, byte in enumerate(data[:9000]):  # the rolling form of the same hash
        h = ((h << 1) + int(media.GEAR[byte])) & 0xFFFFFFFF
        if p + 1 >= media.LEAST and h < 1 << (32 - media.TOP_BITS):
            assert len(a[0]) == p + 1
            break


def test_store_holds_each_chunk_once_and_damage_is_noticed(spark):
    docs = frame(spark, [(1, "a" * 3000), (2, "a" * 3000), (3, "b")])
    store = media.write_store(docs)
    rows = store.collect()
    assert len({bytes(r.digest) for r in rows}) == len(rows) == 2
    lists = media.recipes(docs).dropDuplicates(["media_sha"])
    from pyspark.sql import functions as F
    import bz2

    bad = store.withColumn("data", F.lit(bz2.compress(b"other")))
    with pytest.raises(Exception, match="damaged"):
        media.read_media(lists, bad).collect()


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, out, free = sum(sizes.values()), {}, set(names)
    while free:
        level = (total - sum(out.values())) / sum(w[s] for s in free)
        over = [s for s in free if level * w[s] > most * sizes[s]]
        if not over:
            out |= {s: level * w[s] for s in free}
            break
        for s in over:
            out[s] = most * sizes[s]
            free.remove(s)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_mix_meets_targets_exactly(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        source = rng.choice([None, "a", "b", "b", "b", "b", "c", "é", "Z", "rare" if rng.random() < 0.05 else "b"])
        rows.append((i, " ".join(["w"] * rng.randint(0, 60)), source))
    rows += [(None, None, "a"), (5, "x y", "b"), (5, "x y", "b"), (7, "", "empty")]
    d = frame(spark, rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = mixing.mix(d.repartition(3)).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_mixed_rows_hold_the_taken_words(spark):
    rows = [(i, f"w{i} " + "x\ty " * (i % 7), "en", s, None) for i, s in enumerate("aaabbbbbbbbbbbbccc")] + [(2, "same text", "en", "a", 9)] * 2 + [(90, None, None, None, None)]
    d = frame(spark, rows, DOCS)
    out = mixing.mixed(d)
    assert out.columns == d.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
    want = Counter()
    for r in mixing.mix(d).collect():
        want[r.source] += r.taken
    assert words == +want
    assert mixing.mixed(frame(spark, [], DOCS)).count() == 0 and mixing.mix(frame(spark, [], DOCS)).count() == 0


# Preferences


def test_preference_prompt_is_the_longest_common_prefix(spark):
    turns = [(1, s, k, role, t) for s, last in (("chosen", "yes"), ("rejected", "no")) for k, (role, t) in enumerate([("user", "q"), ("assistant", "a"), ("user", None), ("assistant", last), ("user", "bye")])]
    turns += [(2, s, 0, None, "same") for s in ("chosen", "rejected")] + [(3, "chosen", 0, "assistant", "only")] + [(None, "rejected", None, "user", "x")]
    got = {r.pair_id: r for r in preference.format_preferences(frame(spark, turns, "pair_id long, side string, turn long, role string, text string")).collect()}
    a = got[1]
    assert a.prompt_turns == 3 and a.prompt.endswith("<|im_start|>user\n<|im_end|>\n")
    for side, word in ((a.chosen, "yes"), (a.rejected, "no")):
        mask = a.chosen_mask if side is a.chosen else a.rejected_mask
        b, e = map(int, mask.split(":"))
        assert side[b:e] == word + "<|im_end|>" and side.endswith("bye<|im_end|>\n")
    assert (got[2].prompt_turns, got[2].chosen, got[2].rejected, got[2].chosen_mask) == (1, "", "", "")
    assert got[3].prompt == "" and got[3].rejected == "" and got[3].chosen_mask == "22:36"
    assert got[None].chosen == "" and "x" in got[None].rejected


def test_stale_replies(spark):
    c = [(1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "user", "r"), (1, 3, "assistant", "two"), (2, 0, "user", "alone"), (3, 0, "assistant", None), (3, 0, "assistant", None)]
    rows = preference.stale_reply_pairs(frame(spark, c, "conv_id long, turn long, role string, text string")).collect()
    assert len(rows) == 2 * len(c)
    side = {(r.pair_id, r.turn, r.side): r.text for r in rows}
    assert side[1, 3, "chosen"] == "two" and side[1, 3, "rejected"] == "one" and side[1, 1, "rejected"] == "one" and side[2, 0, "rejected"] == "alone"
    out = preference.format_preferences(preference.stale_reply_pairs(frame(spark, [], "conv_id long, turn long, role string, text string")))
    assert out.count() == 0


# Top-k


def brute_top(rows, k):
    ok = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in ok:
        if i % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ok if j != i)[:k]
            out += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["normal", "clusters", "ties", "large"])
def test_top_scores_match_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.normal(0, 0.125, (260, 12))
    if kind == "clusters":
        v = 0.1 * v + rng.normal(0, 0.2, (5, 12))[rng.integers(0, 5, 260)]
    if kind == "ties":
        v = np.round(v * 8) / 64
    if kind == "large":
        v *= 1e7
    rows = [(i, x) for i, x in enumerate(v.astype(np.float32).tolist())]
    rows += [(300, None), (320, [float("nan")] * 12), (340, [None] + [0.1] * 11), (360, [float("inf")] + [0.1] * 11), (None, [0.1] * 12), (400, [0.5] * 12), (401, [0.5] * 12)]
    got = topk.top_scores(frame(spark, rows, "vec_id long, embedding array<float>")).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 20)


def test_fewer_rows_than_k_and_none(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])]
    assert len(topk.top_scores(frame(spark, rows, "vec_id long, embedding array<float>")).collect()) == 4
    assert topk.top_scores(frame(spark, [], "vec_id long, embedding array<float>")).count() == 0


def test_bounds_stop_early_where_scores_stand_out():
    rng = np.random.default_rng(0)
    q = rng.normal(0, 8, (4, 32)).round()
    v = rng.normal(0, 1, (2000, 32)).round()
    v[:20] = 4 * q[rng.integers(0, 4, 20)]
    left = topk.nra(q, v, np.zeros((4, 2000), bool), 3)
    for i, rows in enumerate(left):
        assert set(np.argsort(-(v @ q[i]), kind="stable")[:3]) <= set(rows.tolist()) and len(rows) < 2000


# WARC


def test_archives_round_trip(spark, tmp_path):
    big, other = "<p>é" + "x" * 3000, "y" * 1000
    rows = [(1, "http://a/ b\r\nc", big), (9, None, big), (4, "http://é", big), (2, "u", other), (3, "u", other[:-1]), (5, "u", other[:-1]), (6, "u", None), (7, "u", ""), (None, "u", big), (9, "u", big), (8, "u", "z" * 2_000_000)]
    pages = frame(spark, rows, "page_id long, url string, html string")
    got = warc.archive_pages(pages).collect()
    assert len(got) == len(rows)
    for r in got:
        data = {(i, len((h or "").encode())): (h or "").encode() for i, _, h in rows}[r.page_id, r.payload_bytes]
        assert r.payload_digest == hashlib.sha1(data).hexdigest()
        revisit = data == big.encode() and r.page_id != 9
        assert (r.record_type, r.refers_to) == (("revisit", 9) if revisit else ("response", None))
    assert warc.archive_pages(frame(spark, [], "page_id long, url string, html string")).count() == 0
    folder = new_path(spark, "warc")
    manifest = warc.write_archives(pages, folder).collect()
    from pathlib import Path

    files = sorted(Path(folder).glob("*.warc.gz"))
    assert {m.path for m in manifest} == {str(f) for f in files}
    assert all(gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n") for f in files)


def test_reader_is_sequential_and_checks_digests():
    rng = random.Random(1)
    payloads = [bytes(rng.randrange(256) for _ in range(n)) for n in (0, 1, 10, 70_000, 300_000)] + [b"\r\n\r\n" * 500]
    data = b"".join(warc.record(i, "http://x", p, None, str(i)) for i, p in enumerate(payloads))

    class Slow(io.BytesIO):
        def read(self, n=-1):
            return super().read(min(n, 777))

    got = list(warc.read_records(Slow(data)))
    assert [(r["bytes"], r["digest"]) for r in got] == [(len(p), hashlib.sha1(p).hexdigest()) for p in payloads]
    plain = gzip.decompress(warc.record(1, None, b"payload", None, "s")).replace(b"payload", b"pAyload")
    with pytest.raises(ValueError, match="digest"):
        list(warc.read_records(io.BytesIO(gzip.compress(plain))))
    with pytest.raises(ValueError, match="Content-Length"):
        list(warc.read_records(io.BytesIO(gzip.compress(gzip.decompress(warc.record(1, None, b"abc", None, "s")) + b"more"))))
    with pytest.raises(ValueError):
        list(warc.read_records(io.BytesIO(data[:-5])))
