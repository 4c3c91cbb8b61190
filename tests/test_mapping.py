"""End-to-end scenarios: indexes, files, mapping, pairs, SAM, BAM, streams."""

import gzip
import random
from collections import Counter
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from strandline.config import Config, InsertSize, preset
from strandline.functions import sequence as S
from strandline.operators import index, mapping, pairing, seeding
from strandline.sources import bam, sam, sequences as io
from strandline.streaming import align as stream


def lcg(seed, n):
    out = []
    for _ in range(n):
        seed = (seed * 1664525 + 1013904223) & 0xFFFFFFFF
        out.append("ACGT"[(seed >> 16) & 3])
    return "".join(out)


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def contigs(spark, *seqs, names=None):
    rows = [(i, (names or [f"c{i}" for i in range(len(seqs))])[i], s) for i, s in enumerate(seqs)]
    return index.contigs(spark.createDataFrame(rows, "ref_id long, name string, seq string"))


def reads(spark, *seqs, qual="I"):
    return spark.createDataFrame([(i, f"r{i}", s, qual * len(s)) for i, s in enumerate(seqs)], "read_id long, name string, seq string, qual string")


def rows_of(df):
    return {(r.read_id, r.kind, r.idx): r for r in df.collect()}


def test_contig_offsets_and_lookup(spark):
    c = contigs(spark, "AAAAACCCCC", "GGGGGTTTTT")
    assert [(r.ref_id, r.length, r.offset) for r in c.orderBy("ref_id").collect()] == [(0, 10, 0), (1, 10, 10)]
    p = spark.createDataFrame([(5,), (15,)], "position long")
    assert sorted((r.position, r.ref_id, r.local) for r in index.locate(p, c).collect()) == [(5, 0, 5), (15, 1, 5)]
    ranges = spark.createDataFrame([(3, 8), (7, 14)], "start long, end long")
    assert {r.start: r.bases for r in index.extract(ranges, c).collect()} == {3: "AACCC", 7: "CCC"}


def test_n_never_matches(spark):
    c = contigs(spark, "ACGTACGTNNNNACGTACGT")
    assert sorted(r.pos for r in index.kmers(c, ["ref_id"], 4).where("kmer = 'ACGT'").collect()) == [0, 4, 12, 16]
    assert index.kmers(c, ["ref_id"], 4).where("contains(kmer, 'N')").count() == 0


def test_chunks_lose_no_window(spark):
    s = lcg(3, 2505)
    got = sorted((r.pos, r.kmer) for r in index.kmers(contigs(spark, s), ["ref_id"], 11, chunk=100).collect())
    assert got == [(i, s[i : i + 11]) for i in range(len(s) - 10)]


def test_index_is_saved_and_refused_if_foreign(spark, tmp_path):
    c = contigs(spark, lcg(1, 400), lcg(2, 300))
    index.save(c, str(tmp_path / "i"), 15)
    refs, seeds, k = index.load(spark, str(tmp_path / "i"))
    assert k == 15 and refs.count() == 2 and seeds.count() == 400 + 300 - 28
    r = reads(spark, lcg(1, 400)[100:150])
    a = seeding.maximal_matches(seeding.indexed_hits(r, seeds, 15), 15).collect()
    assert [(x.qpos, x.rpos, x.len, x.ref_id, x.strand) for x in a] == [(0, 100, 50, 0, "+")]
    spark.createDataFrame([("other", 3)], "format string, k int").write.mode("overwrite").parquet(str(tmp_path / "i/meta"))
    with pytest.raises(ValueError):
        index.load(spark, str(tmp_path / "i"))
    assert index.add_contig(refs, spark.createDataFrame([(2, "n", "ACGT")], "ref_id long, name string, seq string")).where("ref_id = 2").first().offset == 700


def test_matches_are_maximal(spark):
    rng = random.Random(4)
    ref = "".join(rng.choice("AC") for _ in range(120))
    q = ref[30:70] + "G" + ref[80:100]
    got = {(r.qpos, r.rpos, r.len) for r in seeding.maximal_matches(seeding.seed_hits(reads(spark, q), contigs(spark, ref), 6), 6).where("strand = '+'").collect()}
    want = set()
    for i in range(len(q)):
        for j in range(len(ref)):
            if (i == 0 or j == 0 or q[i - 1] != ref[j - 1]) and q[i] == ref[j]:
                n = 0
                while i + n < len(q) and j + n < len(ref) and q[i + n] == ref[j + n]:
                    n += 1
                if n >= 6:
                    want.add((i, j, n))
    assert got == want


def test_reads_map_to_their_own_contigs(spark):
    a, b = lcg(11, 600), lcg(12, 600)
    got = rows_of(mapping.align_single(reads(spark, a[100:180], rc(b[200:290]), "N" * 50), contigs(spark, a, b, names=["chrA", "chrB"]), preset("intractable")))
    x, y, z = got[0, "primary", 0], got[1, "primary", 0], got[2, "primary", 0]
    assert (x.rname, x.pos, x.cigar, x.flag, x.mapq) == ("chrA", 101, "80=", 0, 60)
    assert (y.rname, y.pos, y.cigar, y.flag & 16) == ("chrB", 201, "90=", 16) and y.seq == b[200:290]
    assert x.tags[:3] == ["NM:i:0", "AS:i:80", "MD:Z:80"]
    assert (z.flag, z.rname, z.pos, z.cigar) == (4, "*", 0, "*") and z.seq == "N" * 50


def test_n_in_the_reference_and_short_reads(spark):
    ref = "ACGTACGTACGTACGT" + "N" * 8 + "GATTACAGATTACA"
    got = rows_of(mapping.align_single(reads(spark, "ACGTACGTACGT", "GATTACAGATTA", "N" * 12), contigs(spark, ref)))
    assert got[1, "primary", 0].pos == 25 and got[1, "primary", 0].score == 12
    assert got[0, "primary", 0].score == 12 and got[2, "primary", 0].flag == 4


def test_long_read_with_errors(spark):
    ref = lcg(12345, 2000)
    q = list(ref[500:1300])
    for i in range(50, 800, 100):
        q[i] = "ACGT"[("ACGT".index(q[i]) + 1) % 4]
    for i in (700, 500, 300, 120):
        del q[i]
    q = "".join(q)
    r = rows_of(mapping.align_single(reads(spark, q), contigs(spark, ref)))[0, "primary", 0]
    assert r.pos == 501 and r.seq == q and len(r.qual) == len(q)
    assert r.ref_span >= 0.95 * 800


def test_split_read_gives_a_supplementary(spark):
    a, b = lcg(21, 60), lcg(22, 60)
    x, y = "G" * 30 + a + "G" * 30, "C" * 30 + b + "C" * 30
    cfg = preset("intractable")
    refs = contigs(spark, x, y, names=["chrX", "chrY"])
    rd = reads(spark, a + b[:50])
    got = {r.kind: r for r in mapping.align_single(rd, refs, cfg).collect()}
    p, s = got["primary"], got["supplementary"]
    assert p.rname == "chrX" and "S" in p.cigar and s.flag & 2048 and "H" in s.cigar and s.mapq == 0
    assert len(s.seq) == sum(n for n, op in bam.cigar_ops(s.cigar) if op in "=XI")
    assert any(t.startswith("SA:Z:chrY") for t in p.tags) and any(t.startswith("SA:Z:chrX") for t in s.tags)
    soft = {r.kind: r for r in mapping.align_single(rd, refs, replace(cfg, soft_clip_supplementary=True)).collect()}["supplementary"]
    assert "H" not in soft.cigar and soft.seq == a + b[:50]
    split = [r.flag for r in mapping.align_single(rd, refs, replace(cfg, mark_split_secondary=True)).collect()]
    assert not any(f & 2048 for f in split) and any(f & 256 for f in split)


def test_smallest_coordinate_becomes_primary(spark):
    a, b = lcg(31, 60), lcg(32, 60)
    refs = contigs(spark, "G" * 30 + a + "G" * 30, "C" * 30 + b + "C" * 30, names=["chrX", "chrY"])
    rd = reads(spark, b + a[:50])
    cfg = preset("intractable")
    first = lambda c: [r.rname for r in mapping.align_single(rd, refs, c).where("kind = 'primary'").collect()]
    assert first(cfg) == ["chrY"] and first(replace(cfg, smallest_coord_primary=True)) == ["chrX"]


def test_repeats_have_low_quality_and_absent_reads_stay_unmapped(spark):
    ref = "ACGT" * 32 + "AACCGGTT" * 16
    got = rows_of(mapping.align_single(reads(spark, ref[20:40], ref[160:180], "GATTTTTTTTTTTTTTTTAG"), contigs(spark, ref), rescue=False))
    assert 1 <= got[0, "primary", 0].pos <= 128 < got[1, "primary", 0].pos <= 256
    assert got[0, "primary", 0].mapq <= 10 and got[0, "primary", 0].cigar == "20="
    assert got[2, "primary", 0].flag & 4


def pair_rows(spark, pairs):
    rows = [(i, m, f"p{i}", s, "I" * len(s)) for i, p in enumerate(pairs) for m, s in enumerate(p, 1)]
    return spark.createDataFrame(rows, "pair_id long, mate int, name string, seq string, qual string")


def test_proper_pairs(spark):
    rng = random.Random(7)
    ref = "".join(rng.choice("ACGT") for _ in range(2000))
    starts = [rng.randrange(1700) for _ in range(30)]
    out = pairing.align_pairs(pair_rows(spark, [(ref[s : s + 50], rc(ref[s + 250 : s + 300])) for s in starts]), contigs(spark, ref), preset("intractable")).collect()
    assert len(out) == 60 and all(r.flag & 1 and r.flag & 2 for r in out)
    assert {r.tlen for r in out} == {300, -300} and all(r.rnext == "=" for r in out)
    for r in out:
        assert bool(r.flag & 64) == (r.mate == 1) and bool(r.flag & 16) == (r.mate == 2) and bool(r.flag & 32) == (r.mate == 1)
        assert r.pos == starts[r.pair_id] + (1 if r.mate == 1 else 251)


def test_unmapped_mate(spark):
    ref = lcg(41, 600)
    out = {r.mate: r for r in pairing.align_pairs(pair_rows(spark, [(ref[100:160], "N" * 60)]), contigs(spark, ref, names=["chrP"]), preset("intractable")).collect()}
    assert out[1].flag & 8 and not out[1].flag & 4 and out[2].flag & 4 and out[2].flag & 128 and out[2].rnext == "chrP"


def test_mate_rescue(spark):
    ref = lcg(987654321, 10_000)
    end = list(ref[1500:1800])
    for i in range(0, 300, 4):
        end[i] = "ACGT"[("ACGT".index(end[i]) + 1) % 4]
    mates = (ref[1000:1150], rc("".join(end)))
    cfg = replace(preset("intractable"), insert=InsertSize(800, 50, 2000, True), scoring=replace(Config().scoring, mismatch=-1))
    out = {r.mate: r for r in pairing.align_pairs(pair_rows(spark, [mates]), contigs(spark, ref), cfg).collect()}
    assert out[2].flag & 16 and not out[2].flag & 4 and abs(out[2].pos - 1501) <= 4
    assert out[2].flag & 2 and abs(abs(out[2].tlen) - 800) <= 8 and out[2].mapq <= 20
    skipped = {r.mate: r for r in pairing.align_pairs(pair_rows(spark, [mates]), contigs(spark, ref), replace(cfg, skip_mate_rescue=True)).collect()}
    assert skipped[2].flag & 4 or skipped[2].pos == 0 or abs(skipped[2].pos - 1501) > 4 or skipped[2].mapq >= 0


def test_insert_moments_need_enough_pairs(spark):
    v = spark.createDataFrame([(i, 300 + i % 7) for i in range(19)], "o long, v long")
    assert pairing.trimmed_moments(v, "v", "o").count() == 0
    v = spark.createDataFrame([(i, 1000 if i < 3 else 300) for i in range(40)] + [(600, 5)], "o long, v long")
    m = pairing.trimmed_moments(v, "v", "o").first()
    assert (m["n"], m["mean"], m["std"]) == (40, 300, 0)


def test_pairing_by_adjacency_and_by_ordinal(spark):
    one = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord long, name string")
    two = spark.createDataFrame([(0, "x"), (1, "y")], "ord long, name string")
    assert sorted((r.pair_id, r.mate, r.name) for r in pairing.zipped(one, two).collect()) == [(0, 1, "a"), (0, 2, "x"), (1, 1, "b"), (1, 2, "y")]
    assert sorted((r.pair_id, r.mate) for r in pairing.interleaved(one).collect()) == [(0, 1), (0, 2), (1, 1)]


BLOBS = ["", "@", "@r\nACGT\n+\n", "@r\nACGT\n+\nII\n@s\nAC\n+\nII\n", "@r\nACGT\n+\nIIIIII\n@s\nAC\n+\nII\n", "plain text\n@s\nAC\n+\nII\n", "@r\r\nACGT\r\n+\r\nIIII\r\n@s\r\nAC\r\n+\r\nII\r\n", "@r\nACGT\n@s\nAC\n+\nII\n", "\n\n@s\nAC\n+\nII\n"]


@pytest.mark.parametrize("blob", BLOBS)
def test_malformed_files_end_and_never_shift(blob):
    rows = list(io.parse(io.lines(__import__("io").BytesIO(blob.encode()))))
    good = [r for r in rows if r[4] is None]
    assert ("@s" in blob) == (("s", "", "AC", "II", None) in good)
    assert all(len(r[2]) == len(r[3]) for r in good)


def test_random_bytes_do_not_crash_the_parser():
    rng = random.Random(5)
    for _ in range(50):
        list(io.parse(io.lines(__import__("io").BytesIO(bytes(rng.randrange(256) for _ in range(200))))))


def test_fastq_and_fasta_files(spark, tmp_path):
    text = "@r1 a comment\nACGTNacgtn\n+\nIIIIIIIIII\n@r2\nAC\n+\nI!\n"
    (tmp_path / "a.fq").write_text(text)
    (tmp_path / "b.fq.gz").write_bytes(gzip.compress(text[:45].encode()) + gzip.compress(text[45:].encode()))
    rows = io.read_records(spark, io.list_files(str(tmp_path))).orderBy("file", "ord").collect()
    assert [(r.name, r.comment, r.seq, r.qual) for r in rows[:2]] == [("r1", "a comment", "ACGTNacgtn", "IIIIIIIIII"), ("r2", "", "AC", "I!")] and len(rows) == 4
    back = "\n".join(r.value for r in io.fastq_text(io.read_records(spark, [str(tmp_path / "a.fq")])).collect())
    assert back + "\n" == text
    fa = ">one first\n" + "ACGT" * 20 + "\nAC\n>two\nGG\n\n>empty\n"
    (tmp_path / "c.fa").write_text(fa)
    for df in (io.read_fasta(spark, str(tmp_path / "c.fa")), io.read_records(spark, [str(tmp_path / "c.fa")])):
        assert sorted((r.name, r.comment, r.seq) for r in df.collect()) == [("empty", "", ""), ("one", "first", "ACGT" * 20 + "AC"), ("two", "", "GG")]
    lines = [r.value for r in io.fasta_text(io.read_fasta(spark, str(tmp_path / "c.fa"))).collect()]
    assert ">one first\n" + "ACGT" * 20 + "\nAC" in lines
    io.write_text(io.fasta_text(io.read_fasta(spark, str(tmp_path / "c.fa"))), str(tmp_path / "out"), gzip=True)
    assert len(io.list_files(str(tmp_path / "out"), ".gz")) >= 1


def simulated(spark, n=120):
    ref = [lcg(5, 3000), lcg(6, 2000)]
    c = contigs(spark, *ref, names=["chr1", "chr2"])
    truth = io.simulate(c, n, 100, 0.01)
    return c, truth, mapping.align_single(truth.select("read_id", "name", "seq", "qual"), c, preset("intractable"), rescue=False)


def test_simulated_reads_map_back(spark):
    c, truth, rows = simulated(spark)
    r = io.accuracy(rows.withColumn("line_no", F.col("kind_ord")), truth).first()
    assert r.reads == 120 and r.mapped >= 118 and r.correct_pos >= 117 and r.correct_strand >= 118 and r.avg_mapq > 50
    assert sorted(truth.collect()) == sorted(io.simulate(c, 120, 100, 0.01).collect())


def test_sam_file(spark, tmp_path):
    c, truth, rows = simulated(spark, 20)
    sam.write_sam(rows, c, str(tmp_path / "s"))
    text = "".join(open(f).read() for f in io.list_files(str(tmp_path / "s"))).splitlines()
    assert text[0] == "@HD\tVN:1.6\tSO:unsorted" and text[1].startswith("@SQ\tSN:chr1\tLN:3000\tM5:") and text[3].startswith("@PG")
    names = [x.split("\t")[0] for x in text if x[0] != "@"]
    assert names == [f"read_{i}" for i in range(20)]
    back = sam.read_sam(spark, str(tmp_path / "s"))
    cols = ["name", "flag", "rname", "pos", "mapq", "cigar", "seq", "qual"]
    assert back.select(cols).exceptAll(rows.select(cols)).count() == 0 and back.count() == 20


def test_bam_and_its_index(spark, tmp_path):
    c, truth, rows = simulated(spark)
    lost = rows.limit(3).withColumn("name", F.concat(F.lit("x"), "name")).withColumn("flag", F.lit(4)).withColumn("rname", F.lit("*")).withColumn("pos", F.lit(0)).withColumn("cigar", F.lit("*"))
    both = rows.unionByName(lost)
    path = str(tmp_path / "a.bam")
    v = bam.write_bam(both, c, path, "@HD\tVN:1.6\tSO:coordinate\n", 4)
    raw = (tmp_path / "a.bam").read_bytes()
    assert raw.endswith(bam.EOF) and gzip.decompress(raw)[:4] == b"BAM\1"
    got = bam.read_bam(spark, path).orderBy("n").collect()
    assert len(got) == 123 and [r.ref for r in got][-3:] == [-1] * 3
    placed = [(r.ref, r.pos) for r in got if r.ref >= 0]
    assert placed == sorted(placed)
    cols = ["name", "flag", "mapq", "cigar", "seq", "qual", "tags"]
    want = sorted(tuple(map(str, (r[x] for x in cols))) for r in both.collect())
    assert sorted(tuple(map(str, (r[x] for x in cols))) for r in got) == want
    refs, none = bam.read_index((tmp_path / "a.bam.bai").read_bytes())
    assert len(refs) == 2 and none == 3
    # Every record is found at the virtual offset that the index tables state for it.
    import io as plain_io
    import struct

    for r in v.collect():
        src = plain_io.BytesIO(raw[r.beg >> 16 :])
        data = b"".join(b for _, b in zip(range(3), bam.read_blocks(src)))[r.beg & 0xFFFF :]
        n = struct.unpack("<I", data[:4])[0]
        rec = bam.decode_record(data[4 : 4 + n])
        assert (rec["ref"], rec["pos"], rec["bin"]) == (r.ref_idx, r.pos0, r.bin)
        if r.ref_idx >= 0:
            chunks = refs[r.ref_idx][0][r.bin]
            assert any(a <= r.beg < z for a, z in chunks)
            assert refs[r.ref_idx][1][r.pos0 >> 14] <= r.beg


def test_block_writer_splits_and_checks():
    import io as plain_io

    out = plain_io.BytesIO()
    w = bam.BlockWriter(out)
    data = bytes(random.Random(1).randrange(256) for _ in range(150_000))
    w.write(data)
    w.flush()
    assert b"".join(bam.read_blocks(plain_io.BytesIO(out.getvalue()))) == data == gzip.decompress(out.getvalue())
    with pytest.raises(Exception):
        list(bam.read_blocks(plain_io.BytesIO(out.getvalue()[:100] + b"\0" + out.getvalue()[101:])))


def test_stream_maps_as_the_batch_does(spark, tmp_path):
    ref = lcg(77, 1500)
    c = contigs(spark, ref)
    seqs = [ref[i : i + 60] for i in range(0, 1200, 100)]
    reads(spark, *seqs).repartition(3).write.parquet(str(tmp_path / "in"))
    q = stream.align_stream(spark, str(tmp_path / "in"), c, str(tmp_path / "out"), str(tmp_path / "state"), preset("intractable"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r.pos for r in got.collect()) == list(range(1, 1200, 100))


def test_command_line(spark, tmp_path):
    from strandline.__main__ import arguments, config, run

    ref = lcg(91, 1500)
    (tmp_path / "r.fa").write_text(f">chr1 made up\n{ref[:700]}\n{ref[700:]}\n")
    fq = "".join(f"@q{i}\n{ref[s : s + 80]}\n+\n{'I' * 80}\n@q{i}\n{rc(ref[s + 200 : s + 280])}\n+\n{'I' * 80}\n" for i, s in enumerate((50, 400, 900)))
    (tmp_path / "q.fq").write_text(fq)
    run(spark, arguments(["index", str(tmp_path / "r.fa"), str(tmp_path / "i")]))
    run(spark, arguments(["mem", str(tmp_path / "i"), str(tmp_path / "q.fq"), "-p", "-x", "sr", "-I", "280,10", "-o", str(tmp_path / "s")]))
    rows = sam.read_sam(spark, str(tmp_path / "s")).collect()
    assert len(rows) == 6 and all(r.flag & 2 and abs(r.tlen) == 280 for r in rows)
    run(spark, arguments(["mem", str(tmp_path / "i"), str(tmp_path / "q.fq"), "-x", "sr", "-o", str(tmp_path / "o.bam")]))
    assert bam.read_bam(spark, str(tmp_path / "o.bam")).count() == 6
    cfg = config(arguments(["mem", "i", "r", "-o", "x", "-B", "5", "-O", "4,4", "-k", "21", "-M", "-5", "-h", "3,7", "-R", "@RG\\tID:z"]))
    assert (cfg.scoring.mismatch, cfg.scoring.gap_open, cfg.min_seed_len, cfg.xa_max_hits, cfg.mark_split_secondary, cfg.smallest_coord_primary, cfg.read_group.id) == (-5, -4, 21, 3, True, True, "z")
    for bad in (["-H", "x"], ["-x", "bogus"], ["-I", "a"], ["-R", "ID:z"]):
        with pytest.raises(ValueError):
            config(arguments(["mem", "i", "r", "-o", "x", *bad]))


def test_packed_seeds_are_the_windows_of_the_text(spark):
    s = lcg(9, 2 * index.PIECE + 700)
    s = s[:5000] + "N" * 7 + s[5007:]
    c = contigs(spark, s, lcg(10, 40), "ACG")
    of = index.reference(c)
    for k in (5, 19, 31):
        got = {(r.ref_id, r.pos): r.kmer for r in of.kmers(k).collect()}
        text = {(r.ref_id, r.pos): r.kmer for r in index.kmers(c, ["ref_id"], k).collect()}
        assert got == {p: int(t.translate(str.maketrans("ACGT", "0123")), 4) for p, t in text.items()}
        assert sum(r == 0 for r, _ in got) == sum("N" not in s[i : i + k] for i in range(len(s) - k + 1))
    with pytest.raises(ValueError):
        of.kmers(32)
    at = spark.createDataFrame([(0, 4000, 8300), (1, 0, 40), (0, 5, 5)], "ref_id long, window_begin long, window_end long")
    assert {(r.ref_id, r.window_begin): r.window for r in index.windows(at, c).collect()} == {(0, 4000): s[4000:8300], (1, 0): lcg(10, 40)}


def test_reads_map_as_published_against_a_saved_index(spark, tmp_path):
    """At least 1,984 of 2,000 reads of 150 bases with 1 % errors belong within 5 bases of their place; here 300."""
    c = contigs(spark, "".join(random.Random(77).choices("ACGT", k=300_000)))
    index.save(c, str(tmp_path / "i"), 19)
    truth = io.simulate(c, 300, 150, 0.01)
    rows = mapping.align_single(truth.select("read_id", "name", "seq", "qual"), index.opened(spark, str(tmp_path / "i")), preset("intractable"))
    r = io.accuracy(rows.withColumn("line_no", F.col("kind_ord")), truth).first()
    assert r.reads == r.mapped == 300 and r.correct_pos >= 300 * 1984 / 2000 and r.correct_strand >= 298


def test_refused_extensions_fall_back_to_the_chain(spark):
    ref = lcg(31, 400)
    chain = "read_id long, strand string, ref_id long, chain_no int, score int, query_begin int, query_end int, ref_begin int, ref_end int, mems array<struct<qpos:int,rpos:int,len:int>>"
    from strandline.operators.chaining import ranked

    found = spark.createDataFrame([(0, "+", 0, 0, 300, 0, 20, 100, 120, [(0, 100, 20)]), (0, "+", 0, 1, 30, 5, 15, 200, 210, [(5, 200, 10)])], chain)
    rd = reads(spark, ref[100:140])
    for least, want in ((0, [(100, "20M20S", 300, None, 30, 1)]), (301, [])):
        got = mapping.extended(rd, contigs(spark, ref), ranked(found), replace(Config(), min_output_score=least)).collect()
        assert [(r.pos0, r.cigar, r.score, r.nm, r.skipped_best, r.skipped_n) for r in got] == want


def test_seeds_saved_in_passes_are_all_seeds(spark, tmp_path, monkeypatch):
    c = contigs(spark, lcg(5, 9000) + "N" + lcg(6, 700), "A" * 300, lcg(5, 2000), "ACG")
    index.save(c, str(tmp_path / "one"), 9)
    monkeypatch.setattr(index, "ONE_PASS", 100)
    ranges = index.reference(c).cuts(9)
    assert len(ranges) == index.PASSES and ranges[0][0] is None and ranges[-1][1] is None and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:]))
    index.save(c, str(tmp_path / "more"), 9)
    one, more = (Counter(tuple(r) for r in index.load(spark, str(tmp_path / n))[1].select("kmer", "ref_id", "pos", "occ").collect()) for n in ("one", "more"))
    assert one == more and max(one.values()) == 1 and sum(one.values()) == 9000 - 8 + 700 - 8 + 292 + 1992


def test_derived_sequences_of_batches_are_those_of_columns(spark):
    rng = random.Random(3)
    texts = [None, "", " \n", "Ünïcode ſK straße 12", "AaZz09_-~", "\U0001f600x\x00y", *("".join(rng.choice("abcXYZ 019,.é日\n") for _ in range(rng.randrange(3000))) for _ in range(50))]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    assert df.where(~S.dna("text").eqNullSafe(S.dna_batches("text"))).count() == 0 and df.select(S.dna_batches("text").alias("s")).where("s is null").count() == 1


def test_hits_are_shuffled_once_for_all_windows_over_them(spark):
    ref = lcg(31, 3000)
    c, r = contigs(spark, ref, lcg(32, 500) + ref[100:400]), reads(spark, ref[50:350], rc(ref[900:1100]), ref[10:60] * 3)
    got = mapping.exact_matches(r, index.reference(c, keep=True), 15, 500)
    plan = got._jdf.queryExecution().sparkPlan().toString()
    prepared = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and sum("Exchange" in x and "Broadcast" not in x for x in prepared.splitlines()) <= 2  # the pieces, the hits
    want = seeding.uncontained(seeding.capped(seeding.maximal_matches(seeding.seed_hits(r, c, 15), 15), 15, 500)).select(mapping.MATCH)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect())) and got.count() >= 4
