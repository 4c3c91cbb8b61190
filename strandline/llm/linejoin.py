"""Line dedup by a segment-partition edit join, with DataFrame functions only.

Lines within ``edits`` edits of each other are found among the distinct lines.  A line of length l is cut
into edits + 1 segments; of two such lines one must hold a segment of the other unharmed, near the place
it had.  Segments are indexed by (length, number, content); every line probes, for each length that a partner may have
and each segment, only the substrings that the multi-match bounds leave.  Keys that only one line has are dropped before
any pair is made.  Pairs that share a key and whose character counts differ by no more than the edits allow are verified
by a banded bit-parallel edit distance: the band of 2 * edits + 1 diagonals is one machine word, moved down a row for
each column.  Classes are connected components.

Rows: a null text counts as empty.  Lines are split at newlines and trimmed of blanks, tabs and returns.  Lines
shorter than ``least`` characters take no part in the edit join: those of at least ``shortest`` characters are classed by
equality, and shorter ones are never linked or removed.  Rows that repeat exactly count as one document.
A null doc_id is a document too and sorts first.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import BLOOM, as_row, kept, row_column, stage, unpacked, whole_text
from .components import components

EDITS = 2
LEAST = 24
#: Lines from this length on are classed by the query and the pipeline: all that are not empty.
SHORTEST = 1
#: Classes of characters that are counted, four bits each.
FIELDS = 14
#: Index entries of a key that one task compares with its probes.
CHUNK = 4096
MASK = (1 << 4 * FIELDS) - 1


def line_id(line: str) -> Column:
    """A hash of the line with the lowest bit zero."""
    return F.xxhash64(line).bitwiseAND(F.lit(-2))


def doc_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, row_hash, line_no, line), a row per line."""
    text = whole_text()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row_hash"), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return rows.withColumn("line", F.btrim("line", F.lit(" \t\r")))


def char_counts(line: Column) -> Column:
    """Counts of the characters of a line by code modulo FIELDS, as the sum of count * 16 ^ class, cut to MASK."""
    units = F.array(*(F.lit(1 << 4 * i) for i in range(FIELDS)))
    one = lambda c: F.element_at(units, (F.ascii(c) % FIELDS + 1))
    return F.aggregate(F.split(line, ""), F.lit(0).cast("long"), lambda s, c: (s + one(c)).bitwiseAND(F.lit(MASK)))


def counts_near(a: Column, b: Column, edits: int) -> Column:
    """Whether the character counts differ by no more than ``edits`` edits can make them.

    The difference of two such sums holds the differences of the counts as signed digits; with 8 added to each
    digit they can be read off, and are right whenever all are small, as they are for lines that near.
    """
    every = lambda n: sum(n << 4 * i for i in range(FIELDS))
    digits = (a - b + F.lit(every(8))).bitwiseAND(F.lit(MASK))
    negative = F.shiftrightunsigned(digits.bitwiseXOR(F.lit(every(8))).bitwiseAND(F.lit(every(8))), 3)
    size = digits.bitwiseXOR(F.lit(every(8))).bitwiseXOR(negative * 15) + negative  # each digit's absolute value
    low = sum(15 << 8 * i for i in range(FIELDS // 2))
    total = size.bitwiseAND(F.lit(low)) + F.shiftrightunsigned(size, 4).bitwiseAND(F.lit(low))
    for shift in (32, 16, 8):
        total = total + F.shiftrightunsigned(total, shift)
    return total.bitwiseAND(F.lit(255)) <= 2 * edits


def probes(edits: int) -> list[tuple[int, int, int, bool]]:
    """(length less by, segment, shift, is it the line's own segment) of all substrings that a line probes.

    A line's own segments are its index entries, and also what it probes at its own length without a shift.
    """
    out = []
    for delta in range(edits + 1):
        for i in range(edits + 1):
            low, high = max(-i, delta - (edits - i)), min(i, delta + (edits - i))
            out += [(delta, i, shift, not delta and not shift) for shift in range(low, high + 1)]
    return out


def keys(lines: DataFrame, edits: int, least: int) -> DataFrame:
    """``lines(id, line, size)`` to (key, id, own): index entries (own) and probes."""
    spec = F.array(*(F.struct(F.lit(d).alias("d"), F.lit(i).alias("i"), F.lit(s).alias("s"), F.lit(o).alias("own")) for d, i, s, o in probes(edits)))
    each = lines.select("id", "line", "size", F.explode(spec).alias("p"))
    parts, length = edits + 1, F.col("size") - F.col("p.d")
    # Segments are as even as can be, the longer ones last.
    each = each.select("id", "line", "size", "p", length.alias("length"), F.floor(length / parts).cast("int").alias("q"), (F.lit(parts) - length % parts).alias("short"))
    start = F.col("p.i") * F.col("q") + F.greatest(F.col("p.i") - F.col("short"), F.lit(0)) + F.col("p.s")
    size = F.col("q") + F.when(F.col("p.i") >= F.col("short"), 1).otherwise(0)
    each = each.select("id", "line", "size", "p", "length", start.alias("at"), size.alias("n"))
    each = each.where((F.col("length") >= least) & (F.col("at") >= 0) & (F.col("at") + F.col("n") <= F.col("size")))
    key = F.xxhash64("length", "p.i", F.substring("line", F.col("at") + 1, F.col("n")))
    return each.select(key.alias("key"), "id", F.col("p.own").alias("own"))


def within_edits(pairs: DataFrame, edits: int) -> DataFrame:
    """Keep the rows of ``pairs(..., a, b)`` whose texts are at most ``edits`` edits apart."""
    width, ones = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    near = pairs.where(F.abs(F.length("a") - F.length("b")) <= edits)
    p = near.withColumn("x_", F.when(F.length("a") >= F.length("b"), F.col("a")).otherwise(F.col("b")))
    p = p.withColumn("y_", F.when(F.length("a") >= F.length("b"), F.col("b")).otherwise(F.col("a")))
    p = p.withColumn("cx_", F.split("x_", "")).withColumn("cy_", F.split("y_", ""))
    # An equal beginning and end change nothing.
    differs = lambda x, y: F.array_position(F.zip_with(x, y, lambda u, v: u != v), True).cast("int")
    p = p.withColumn("i_", differs(F.col("cx_"), F.col("cy_"))).withColumn("n_", F.least(F.length("x_"), F.length("y_")))
    p = p.withColumn("head_", F.when(F.col("i_") == 0, F.col("n_")).otherwise(F.col("i_") - 1))
    p = p.withColumn("j_", differs(F.reverse("cx_"), F.reverse("cy_")))
    p = p.withColumn("tail_", F.least(F.when(F.col("j_") == 0, F.col("n_")).otherwise(F.col("j_") - 1), F.col("n_") - F.col("head_")))
    middle = lambda t: F.substring(t, F.col("head_") + 1, F.length(t) - F.col("head_") - F.col("tail_"))
    p = p.withColumn("mx_", middle("x_")).withColumn("my_", middle("y_"))
    p = p.withColumn("d_", F.length("x_") - F.length("y_"))
    # A transform of one element gives a value a name within an expression, so that it is computed once.
    named = lambda value, f: F.get(F.transform(F.array(value), f), F.lit(0))
    flip = lambda v: v.bitwiseXOR(F.lit(ones))

    def matches(t, s, j):
        # Bit k of the word stands for row j - edits + k of column j.
        c, word = F.get(t["y"], j - 1), F.lit(0).cast("long")
        for k in range(width):
            row = F.get(t["x"], j - F.lit(edits - k) - 1)
            word = word + F.when(F.coalesce(row == c, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        return F.struct(s["vp"].alias("vp"), s["vn"].alias("vn"), s["n"].alias("n"), word.alias("m"))

    def diagonals(s):
        vp, vn, m = s["vp"], s["vn"], s["m"]
        d0 = (m.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(m).bitwiseOR(vn).bitwiseAND(F.lit(ones))
        return F.struct(vp.alias("vp"), vn.alias("vn"), s["n"].alias("n"), d0.alias("d"))

    def move(t, s):
        vp, vn, d0 = s["vp"], s["vn"], s["d"]
        hp = vn.bitwiseOR(flip(d0.bitwiseOR(vp)))
        down = F.shiftright(d0, 1)
        up = d0.bitwiseAND(vp).bitwiseOR(flip(down.bitwiseOR(hp)))
        on_diagonal = F.call_function("shiftright", d0, F.lit(edits) + t["d"]).bitwiseAND(F.lit(1))
        return F.struct(up.alias("vp"), down.bitwiseAND(hp).alias("vn"), (s["n"] + F.when(on_diagonal == 0, 1).otherwise(0)).alias("n"))

    def distance(t):
        start = F.struct(F.lit(ones ^ ((1 << edits) - 1)).cast("long").alias("vp"), F.lit(0).cast("long").alias("vn"), t["d"].alias("n"))
        step = lambda s, j: named(named(matches(t, s, j), diagonals), lambda v: move(t, v))
        return F.aggregate(F.sequence(F.lit(1), F.size(t["y"])), start, step, lambda s: s["n"])

    texts = F.struct(F.split("mx_", "").alias("x"), F.split("my_", "").alias("y"), F.col("d_").alias("d"))
    p = p.withColumn("edits_", F.when(F.length("my_") == 0, F.col("d_")).otherwise(named(texts, distance)))
    return kept(p, F.col("edits_") <= edits).select(*pairs.columns)


def line_links(lines: DataFrame, edits: int = EDITS, least: int = LEAST) -> DataFrame:
    """``lines(id, line, size)``, distinct and staged, to verified links (u, v) between ids.  Ids are even."""
    spark = lines.sparkSession
    # Keys that one line alone has, or that no line is indexed by, are dropped: partial sums tell the others, which are
    # joined back as a table of their own, so that no task holds a key and AQE can split a large one.  The join is of one
    # kind at every size, for the table of shared keys grows with the lines.
    rows = keys(lines, edits, least)
    ends = rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z"), F.count_if("own").alias("entries"))
    shared = stage(ends.where("a <> z and entries > 0").select("key", F.ceil(F.col("entries") / CHUNK).cast("int").alias("parts")), "shared")
    met = stage(rows.join(shared.hint("merge"), "key").select("key", "id", "own", "parts"), "met")
    # No id is odd, so the filter keeps all; it lets Spark filter the lines by a Bloom filter of a bounded size before it shuffles them.
    asked = stage(met.select("id").distinct(), "asked").where("id <> 1")
    before = spark.conf.get(BLOOM)
    spark.conf.set(BLOOM, "0")
    try:
        texts = stage(lines.join(asked, "id").select("id", "line", "size", char_counts(F.col("line")).alias("counts")), "texts")
    finally:
        spark.conf.set(BLOOM, before)
    # The entries of a key are dealt into parts of about CHUNK; every probe goes to each part, and each is joined by itself.
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    entries = met.where("own").withColumn("part", part)
    probing = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    side = lambda x, c: x.join(texts.select("id", "size", "counts"), "id").select("key", "part", F.col("id").alias(c), F.col("size").alias(f"size_{c}"), F.col("counts").alias(f"counts_{c}"))
    longer = (F.col("size_v") > F.col("size_u")) | ((F.col("size_v") == F.col("size_u")) & (F.col("v") > F.col("u")))
    pairs = side(entries, "u").join(side(probing, "v"), ["key", "part"]).where(longer & counts_near(F.col("counts_u"), F.col("counts_v"), edits))
    pairs = stage(pairs.select("u", "v").distinct(), "candidates")
    full = pairs.join(texts.select(F.col("id").alias("u"), F.col("line").alias("a")), "u").join(texts.select(F.col("id").alias("v"), F.col("line").alias("b")), "v")
    return within_edits(full, edits).select("u", "v")


def line_classes(docs: DataFrame, edits: int = EDITS, least: int = LEAST, shortest: int | None = None) -> DataFrame:
    """A row per line: doc_id, row_hash, line_no, class_id, kept_doc_id, kept_line_no, removed.

    The first line of a class, by (doc_id, row_hash, line_no), is kept.  Lines under ``shortest`` characters (``least``
    if it is None) have a null class_id.
    """
    shortest = least if shortest is None else shortest
    lines = doc_lines(docs)
    known = lines.where(F.length("line") >= least).select("line").distinct()
    known = stage(known.select(line_id("line").alias("id"), "line", F.length("line").alias("size")), "lines")
    comp = stage(components(line_links(known, edits, least)), "classes")
    places = lines.select("doc_id", "row_hash", "line_no", F.when(F.length("line") >= shortest, line_id("line")).alias("id"))
    places = places.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("class_id", F.coalesce("label", "id")).drop("label", "id")
    places = stage(places, "line_places")
    here = F.struct("doc_id", "row_hash", "line_no")
    keep = places.where("class_id is not null").groupBy("class_id").agg(F.min(here).alias("k"), F.count("*").alias("n")).where("n > 1").select("class_id", "k")
    keep = stage(keep, "keep")  # a table of its own, so that a class with very many places can be split in the join
    rows = places.join(keep, "class_id", "left")
    kept = lambda c: F.when(F.col("k").isNull(), F.col(c)).otherwise(F.col(f"k.{c}"))
    removed = F.col("k").isNotNull() & ~F.struct(*(F.col(c) for c in ("doc_id", "row_hash", "line_no"))).eqNullSafe(F.col("k"))
    return rows.select("doc_id", "row_hash", "line_no", "class_id", kept("doc_id").alias("kept_doc_id"), kept("line_no").cast("int").alias("kept_line_no"), removed.alias("removed"))


def drop_repeated_lines(docs: DataFrame, edits: int = EDITS, least: int = LEAST, shortest: int | None = None) -> DataFrame:
    """``docs`` without the removed lines, with the columns it had; ``n_chars``, if there, follows.

    A document goes if lines were removed from it and nothing but white space is left.
    """
    gone = line_classes(docs.select("doc_id", "text"), edits, least, shortest).where("removed")
    gone = gone.groupBy(F.struct("doc_id", "row_hash").alias("gone_from")).agg(F.collect_set("line_no").alias("gone"))
    at = F.col("gone_from")
    mine = as_row(docs, hash_=F.xxhash64(whole_text()))
    rows = mine.join(gone, (F.col("hash_") == at["row_hash"]) & row_column("doc_id").cast("long").eqNullSafe(at["doc_id"]), "left")
    text, untouched = row_column("text"), F.col("gone").isNull()
    left = F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("gone", i))
    rows = rows.select("row_", untouched.alias("untouched"), F.when(untouched, text).otherwise(F.array_join(left, "\n")).alias("left"))
    rows = rows.where(F.col("untouched") | (F.length(F.btrim("left", F.lit(" \t\r\n"))) > 0))
    new = {"text": F.col("left")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("untouched"), row_column("n_chars")).otherwise(F.length("left").cast(docs.schema["n_chars"].dataType))
    return unpacked(rows, docs.columns, **new)
