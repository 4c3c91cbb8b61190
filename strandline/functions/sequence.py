"""Column functions on sequences, CIGARs, flags and scores; all but ``dna_batches`` stay in Catalyst."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, functions as F

LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"
BASES = "ACGTACGTACGTACGTACGTACGTACNNNNNNNNNN"
#: Fixed by the SAM format: the operations of a CIGAR in the order of their codes.
OPS = "MIDNSHP=X"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dna(text) -> Column:
    """A sequence over ACGTN derived from any text, for tables without sequences."""
    return F.translate(F.lower(F.regexp_replace(col(text), "[^A-Za-z0-9]", "")), LETTERS, BASES)


def _letters() -> np.ndarray:
    """The base of each byte that has one, 0 for the others."""
    out = np.zeros(256, np.uint8)
    for letter, base in zip(LETTERS, BASES):
        out[ord(letter)] = out[ord(letter.upper())] = ord(base)
    return out


def dna_batches(text) -> Column:
    """As ``dna``, for long texts: the bytes of a batch are looked up at once, where translate looks up one character at a time."""
    table = _letters()

    @F.arrow_udf("string")
    def run(x: pa.Array) -> pa.Array:
        if not len(x):
            return x.cast(pa.string())
        x = x.cast(pa.large_binary())
        ends = np.frombuffer(x.buffers()[1], np.int64)[x.offset : x.offset + len(x) + 1]
        found = table[np.frombuffer(x.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]]
        kept = found != 0
        sizes = np.r_[0, np.cumsum(kept)][ends - ends[0]]
        out = pa.LargeStringArray.from_buffers(len(x), pa.py_buffer(sizes.astype(np.int64)), pa.py_buffer(found[kept]))
        return pa.compute.if_else(x.is_valid(), out, pa.scalar(None, pa.large_string())).cast(pa.string())

    return run(col(text))


def normalize(seq) -> Column:
    """Upper case, and N for all that is not A, C, G or T."""
    return F.regexp_replace(F.upper(col(seq)), "[^ACGT]", "N")


def encode(seq) -> Column:
    """Codes 0 to 3 for ACGT and 4 for the rest, a digit a base."""
    return F.translate(normalize(seq), "ACGTN", "01234")


def decode(codes) -> Column:
    return F.translate(col(codes), "01234", "ACGTN")


def reverse_complement(seq) -> Column:
    return F.reverse(F.translate(col(seq), "ACGTacgt", "TGCATGCA"))


def pack_op(op, length) -> Column:
    """An operation's code and length in one int."""
    return F.shiftleft(col(length), 4).bitwiseOR(col(op))


def op_length(packed) -> Column:
    return F.shiftrightunsigned(col(packed), 4)


def op_code(packed) -> Column:
    return col(packed).bitwiseAND(F.lit(15))


def op_char(code) -> Column:
    return F.substring(F.lit(OPS), col(code) + 1, F.lit(1))


def format_cigar(ops) -> Column:
    """``array<struct<op, len>>`` to text; ``*`` if there is none."""
    text = F.array_join(F.transform(col(ops), lambda o: F.concat(o["len"].cast("string"), o["op"])), "")
    return F.when(F.coalesce(F.size(col(ops)), F.lit(0)) > 0, text).otherwise(F.lit("*"))


def parse_cigar(text) -> Column:
    """CIGAR text to ``array<struct<op, len>>``."""
    parts = F.regexp_extract_all(col(text), F.lit("([0-9]+[MIDNSHP=X])"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(F.right(p, F.lit(1)).alias("op"), F.substring(p, F.lit(1), F.length(p) - 1).cast("int").alias("len")))


def cigar_sum(ops, kinds: str) -> Column:
    """The total length of the operations whose letters are in ``kinds``."""
    return F.aggregate(col(ops), F.lit(0), lambda s, o: s + F.when(F.instr(F.lit(kinds), o["op"]) > 0, o["len"]).otherwise(F.lit(0)))


def reference_span(ops) -> Column:
    return cigar_sum(ops, "M=XDN")


def query_span(ops) -> Column:
    return cigar_sum(ops, "M=XI")


def edit_count(ops) -> Column:
    """NM: mismatched, inserted and deleted bases."""
    return cigar_sum(ops, "XID")


def chain_cigar(mems, query_len) -> Column:
    """The CIGAR of a chain ``array<struct<qpos, rpos, len>>`` without alignment.

    Ends are soft-clipped; of the gap between two matches what both sides have is matched and the rest is an insertion
    or a deletion.
    """
    m = col(mems)
    part = lambda n, op: F.when(n > 0, F.concat(n.cast("string"), F.lit(op))).otherwise(F.lit(""))

    def step(s, x):
        q, r = x["qpos"] - s["q"], x["rpos"] - s["r"]
        gap = F.concat(part(F.least(q, r), "M"), part(q - r, "I"), part(r - q, "D"))
        text = F.when(s["q"] < 0, part(x["qpos"], "S")).otherwise(F.concat(s["text"], gap))
        return F.struct(F.concat(text, part(x["len"], "M")).alias("text"), (x["qpos"] + x["len"]).alias("q"), (x["rpos"] + x["len"]).alias("r"))

    start = F.struct(F.lit("").alias("text"), F.lit(-1).alias("q"), F.lit(-1).alias("r"))
    return F.aggregate(m, start, step, lambda s: F.concat(s["text"], part(col(query_len) - s["q"], "S")))


def reg2bin(beg, end) -> Column:
    """The bin of the half-open range in the binning scheme of BAM indexes."""
    b, e = col(beg).cast("long"), col(end).cast("long") - 1
    out = F.lit(0)
    for shift, first in ((26, 1), (23, 9), (20, 73), (17, 585), (14, 4681)):
        out = F.when(F.shiftright(b, shift) == F.shiftright(e, shift), F.lit(first) + F.shiftright(b, shift)).otherwise(out)
    return out.cast("int")


FLAGS = {"paired": 1, "proper": 2, "unmapped": 4, "mate_unmapped": 8, "reverse": 16, "mate_reverse": 32, "first": 64, "second": 128, "secondary": 256, "supplementary": 2048}


def flag(**on) -> Column:
    """The SAM flag with the named bits set where their columns are true."""
    out = F.lit(0)
    for name, c in on.items():
        out = out.bitwiseOR(F.when(F.coalesce(col(c), F.lit(False)), F.lit(FLAGS[name])).otherwise(F.lit(0)))
    return out


def has_flag(value, name: str) -> Column:
    return col(value).bitwiseAND(F.lit(FLAGS[name])) != 0


def split_as_secondary(value) -> Column:
    """A supplementary record marked as secondary instead."""
    v = col(value)
    return F.when(has_flag(v, "supplementary"), v.bitwiseAND(F.lit(~FLAGS["supplementary"])).bitwiseOR(F.lit(FLAGS["secondary"]))).otherwise(v)


def mapq(score, sub, csub, sub_n, query_len, ref_len, match: int = 1, mismatch: int = 4, min_seed_len: int = 9) -> Column:
    """Mapping quality of a hit from its score and those of its rivals, 0 to 60."""
    score, sub, csub, sub_n = col(score), col(sub), col(csub), col(sub_n)
    rival = F.greatest(F.when(sub != 0, sub).otherwise(F.lit(min_seed_len * match)), csub)
    size = F.greatest(col(query_len), col(ref_len)).cast("double")
    identity = 1.0 - (size * match - score) / float(match + mismatch) / size
    weight = F.when(size < 50, F.lit(1.0)).otherwise(F.lit(3.912023005428146) / F.ln(size)) * identity * identity
    raw = (F.lit(6.02) * (score - rival) / float(match) * weight * weight + 0.499).cast("int")
    less = F.when(sub_n > 0, (F.lit(4.343) * F.ln(sub_n + 1.0) + 0.499).cast("int")).otherwise(F.lit(0))
    none = (rival >= score) | (size <= 0) | (score == 0)
    return F.when(none, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(F.lit(60), raw - less)))


def five_prime(pos, reverse, span) -> Column:
    """The position of the 5' end of a record at ``pos``."""
    return F.when(col(reverse), col(pos) + col(span) - 1).otherwise(col(pos))


def template_length(own5, mate5) -> Column:
    """Signed distance of 5' ends, positive for the leftmost; the first of equals is positive."""
    size = F.abs(col(own5) - col(mate5)) + 1
    return F.when(col(own5) <= col(mate5), size).otherwise(-size)


def phred_values(quality) -> Column:
    return F.transform(F.split(col(quality), ""), lambda c: F.greatest(F.ascii(c) - 33, F.lit(0)))


def phred_text(values) -> Column:
    return F.array_join(F.transform(col(values), lambda v: F.chr(F.least(v + 33, F.lit(126)))), "")


def format_bytes(n) -> Column:
    """A number of bytes with a unit, two decimals above bytes; a tie goes to the even digit, as printf has it.

    The digits come from whole numbers: format_string rounds ties up.
    """
    n = col(n).cast("double").cast("long")
    out = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in ((10, "KB"), (20, "MB"), (30, "GB"), (40, "TB")):
        one = F.lit(1 << power).cast("long")
        parts = n.bitwiseAND(one - 1) * 100
        down, rest = F.shiftright(parts, power), parts.bitwiseAND(one - 1) * 2
        up = (rest > one) | ((rest == one) & (down % 2 == 1))
        cents = down + up.cast("long")  # 100 of them are a whole
        whole = F.shiftright(n, power) + (cents == 100).cast("long")
        size = F.concat(whole.cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(f" {unit}"))
        out = F.when(n >= one, size).otherwise(out)
    return out


def header_name(line) -> Column:
    return F.substring_index(col(line), " ", 1)


def header_comment(line) -> Column:
    at = F.instr(col(line), " ")
    return F.when(at > 0, F.substring(col(line), at + 1, F.length(col(line)))).otherwise(F.lit(""))


def wrapped(seq, width: int = 80) -> Column:
    """A sequence in lines of ``width`` characters, each ended by a newline."""
    return F.regexp_replace(F.regexp_replace(col(seq), f"(.{{1,{width}}})", "$1\n"), "\n\n", "\n")


def sa_entry(rname, pos, reverse, cigar, quality, edits) -> Column:
    """An entry of the SA tag."""
    strand = F.when(col(reverse), F.lit("-")).otherwise(F.lit("+"))
    return F.concat(F.concat_ws(",", col(rname), col(pos).cast("string"), strand, col(cigar), col(quality).cast("string"), col(edits).cast("string")), F.lit(";"))


SQL_FUNCTIONS = {
    "reverse_complement": "CREATE OR REPLACE TEMPORARY FUNCTION reverse_complement(s STRING) RETURNS STRING RETURN reverse(translate(s, 'ACGTacgt', 'TGCATGCA'))",
    "reg2bin": "CREATE OR REPLACE TEMPORARY FUNCTION reg2bin(b BIGINT, e BIGINT) RETURNS INT RETURN cast(CASE WHEN b >> 14 = (e - 1) >> 14 THEN 4681 + (b >> 14) WHEN b >> 17 = (e - 1) >> 17 THEN 585 + (b >> 17) WHEN b >> 20 = (e - 1) >> 20 THEN 73 + (b >> 20) WHEN b >> 23 = (e - 1) >> 23 THEN 9 + (b >> 23) WHEN b >> 26 = (e - 1) >> 26 THEN 1 + (b >> 26) ELSE 0 END AS INT)",
    "cigar_ref_span": "CREATE OR REPLACE TEMPORARY FUNCTION cigar_ref_span(c STRING) RETURNS INT RETURN aggregate(regexp_extract_all(c, '([0-9]+)[M=XDN]', 1), 0, (s, x) -> s + cast(x AS INT))",
}


def register(spark) -> None:
    """Make the functions callable from SQL; they are inlined, so plans stay in Catalyst."""
    for text in SQL_FUNCTIONS.values():
        spark.sql(text)
