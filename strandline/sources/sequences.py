"""FASTA and FASTQ: readers, writers, and simulated reads.

Plain FASTA is split by Spark at record starts.  FASTQ records span four lines and compressed files cannot be split,
so those are read a file a task, line by line, without holding the file.
"""

from __future__ import annotations

import posixpath
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import sequence as S

READS = "file string, ord long, name string, comment string, seq string, qual string, error string"
ROWS = 4096
PIECE = 1 << 16


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def lines(source) -> Iterator[str]:
    """Lines of a plain or gzip-compressed stream, without line ends; several gzip members follow each other."""
    rest, z, first = b"", None, True
    while raw := source.read(PIECE):
        if first and raw[:2] == b"\x1f\x8b":
            z = zlib.decompressobj(31)
        first = False
        if z is not None:
            data = z.decompress(raw)
            while z.eof and z.unused_data:
                more, z = z.unused_data, zlib.decompressobj(31)
                data += z.decompress(more)
            raw = data
        *whole, rest = (rest + raw).split(b"\n")
        for x in whole:
            yield x.rstrip(b"\r").decode("utf-8", "replace")
    if rest:
        yield rest.rstrip(b"\r").decode("utf-8", "replace")


def parse(rows: Iterator[str]) -> Iterator[tuple[str, str, str, str, str | None]]:
    """(name, comment, seq, qual, error) of FASTA or FASTQ text; blank lines between records are skipped.

    A record that is no record gives a row with an error and never shifts the ones after it.
    """
    back: list[str] = []  # lines to be read again, the next one last

    def after() -> str | None:
        return back.pop() if back else next(rows, None)

    while (line := after()) is not None:
        if not line:
            continue
        name, _, comment = line[1:].partition(" ")
        if line[0] == ">":
            parts = []
            while (line := after()) is not None and line[:1] not in (">", "@"):
                parts.append(line)
            if line is not None:
                back.append(line)
            yield name, comment, "".join(parts), "", None
        elif line[0] == "@":
            seq, plus, qual = after(), after(), after()
            if seq is not None and plus is not None and plus[:1] != "+":
                # The lines that may begin or belong to the next record are read again.
                again = [plus, qual] if plus[:1] in ("@", ">") else [qual] if (qual or "")[:1] in ("@", ">") else []
                back += [x for x in reversed(again) if x is not None]
                yield name, comment, seq, "", "no separator line"
            elif seq is None or plus is None or qual is None:
                yield name, comment, seq or "", "", "the record ends early"
            elif len(seq) != len(qual):
                yield name, comment, seq, "", "sequence and quality differ in length"
            else:
                yield name, comment, seq, qual, None
        else:
            yield "", "", "", "", "not a header line"


def read_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """READS of FASTA or FASTQ files, ``ord`` counting from 0 in each file; a file is a task."""

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                system, at = open_path(path)
                with system.open_input_stream(at, compression=None) as source:
                    part: list[tuple] = []
                    for n, r in enumerate(parse(lines(source))):
                        part.append((path, n, *r))
                        if len(part) == ROWS:
                            yield _batch(part)
                            part = []
                    if part:
                        yield _batch(part)

    files = spark.createDataFrame([(p,) for p in paths], "file string").repartition(max(1, len(paths)), "file")
    return files.mapInArrow(run, READS)


def _batch(part: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), *[pa.string()] * 5]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*part), kinds)], [c.split()[0] for c in READS.split(", ")])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(name, comment, seq) of plain FASTA, split by Spark between records."""
    raw = spark.read.option("lineSep", "\n>").text(path).where("value <> ''")
    text = F.regexp_replace(F.regexp_replace("value", "^>", ""), "\r", "")
    head = F.substring_index(text, "\n", 1)
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.substring(text, F.length(head) + 2, F.length(text)), "\n", "")).otherwise(F.lit(""))
    return raw.select(S.header_name(head).alias("name"), S.header_comment(head).alias("comment"), body.alias("seq"))


def fasta_text(records: DataFrame, width: int = 80) -> DataFrame:
    """A text of each record, without the last line end."""
    head = F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit(">"), F.col("name"), F.lit(" "), F.col("comment"))).otherwise(F.concat(F.lit(">"), F.col("name")))
    return records.select(F.rtrim(F.regexp_replace(F.concat(head, F.lit("\n"), S.wrapped("seq", width)), "\n$", "")).alias("value"))


def fastq_text(reads: DataFrame) -> DataFrame:
    head = F.when(F.coalesce("comment", F.lit("")) != "", F.concat(F.lit("@"), F.col("name"), F.lit(" "), F.col("comment"))).otherwise(F.concat(F.lit("@"), F.col("name")))
    return reads.select(F.concat_ws("\n", head, F.col("seq"), F.lit("+"), F.col("qual")).alias("value"))


def write_text(rows: DataFrame, path: str, gzip: bool = False) -> None:
    (rows.write.mode("overwrite").option("compression", "gzip") if gzip else rows.write.mode("overwrite")).text(path)


def list_files(path: str, suffix: str = "") -> list[str]:
    """The data files below a folder, or the file itself."""
    system, at = open_path(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [path]
    names = sorted(posixpath.basename(x.path) for x in system.get_file_info(fs.FileSelector(at)) if x.type == fs.FileType.File)
    return [posixpath.join(path, n) for n in names if not n.startswith(("_", ".")) and n.endswith(suffix)]


def digit(seed: str, *parts):
    """A hash-random number from 0 to 2^28 - 1, equal in every SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(p.cast("string") for p in parts))), 1, 7), 16, 10).cast("long")


def random_sequences(spark: SparkSession, n: int, length: int, seed: str = "42", n_rate: int = 0) -> DataFrame:
    """(id, seq): random bases; of a million, ``n_rate`` are N."""
    each = spark.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("i"))
    value = digit(seed, F.col("id"), F.col("i"))
    base = F.when(F.floor(value / 4) % 1_000_000 < n_rate, "N").otherwise(F.substring(F.lit("ACGT"), (value % 4 + 1).cast("int"), F.lit(1)))
    rows = each.select("id", F.struct("i", base.alias("b")).alias("x"))
    return rows.groupBy("id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["b"]), "").alias("seq"))


def simulate(refs: DataFrame, n: int, length: int, error: float = 0.01, seed: str = "7") -> DataFrame:
    """(read_id, name, seq, qual, ref_id, pos, reverse): reads with substitutions and their true places.

    Contigs are drawn by their share of possible starts.
    """
    from ..operators.index import locate, offsets, windows

    spark = refs.sparkSession
    starts = refs.where(F.length("seq") >= length).select("ref_id", (F.length("seq") - length + 1).cast("long").alias("length"))
    total = starts.agg(F.sum("length")).first()[0] or 0
    if not total:
        return spark.createDataFrame([], "read_id long, name string, seq string, qual string, ref_id long, pos int, reverse boolean")
    reads = spark.range(n).select(F.col("id").alias("read_id"), (digit(seed, F.col("id")) * (1 << 28) + digit(seed, F.col("id"), F.lit("b"))) % F.lit(total))
    at = locate(reads.toDF("read_id", "position"), starts.join(offsets(starts), "ref_id"))
    at = at.select("read_id", "ref_id", F.col("local").alias("window_begin"), (F.col("local") + length).alias("window_end"))
    rows = windows(at, refs).select("read_id", "ref_id", F.col("window_begin").cast("int").alias("pos"), F.col("window").alias("true_seq"))
    rows = rows.withColumn("reverse", digit(seed, F.col("read_id"), F.lit("strand")) % 2 == 1)
    turned = F.when(F.col("reverse"), S.reverse_complement("true_seq")).otherwise(F.col("true_seq"))
    limit = int(error * (1 << 28))

    def noisy(c, i):
        u, v = digit(seed, F.col("read_id"), i, F.lit("e")), digit(seed, F.col("read_id"), i, F.lit("s"))
        at = F.instr(F.lit("ACGT"), c)
        return F.when((u < limit) & (at > 0), F.substring(F.lit("ACGT"), ((at - 1 + 1 + v % 3) % 4 + 1).cast("int"), F.lit(1))).otherwise(c)

    seq = F.array_join(F.transform(F.split(turned, ""), noisy), "")
    return rows.select("read_id", F.concat(F.lit("read_"), F.col("read_id").cast("string")).alias("name"), seq.alias("seq"), F.repeat(F.lit("I"), F.lit(length)).alias("qual"), "ref_id", "pos", "reverse")


def accuracy(sam: DataFrame, truth: DataFrame, near: int = 5) -> DataFrame:
    """Counts of mapped, rightly placed and rightly turned reads; the last primary record of a name counts."""
    from pyspark.sql import Window

    last = Window.partitionBy("name").orderBy(F.desc("line_no"))
    rows = sam.where(~S.has_flag("flag", "secondary") & ~S.has_flag("flag", "supplementary")).withColumn("n_", F.row_number().over(last)).where("n_ = 1")
    t = truth.select("name", F.col("pos").alias("true_pos"), F.col("reverse").alias("true_reverse"))
    rows = t.join(rows.select("name", "flag", "pos", "mapq", "cigar"), "name", "left")
    mapped = F.coalesce(~S.has_flag("flag", "unmapped"), F.lit(False))
    right = mapped & (F.abs(F.col("pos") - 1 - F.col("true_pos")) <= near)
    count = lambda c: F.count_if(c)
    return rows.agg(F.count("*").alias("reads"), count(mapped).alias("mapped"), count(right).alias("correct_pos"), count(mapped & (S.has_flag("flag", "reverse") == F.col("true_reverse"))).alias("correct_strand"), count(mapped & F.col("cigar").rlike("^[0-9]+=$")).alias("perfect_cigar"), F.avg(F.when(mapped, F.col("mapq"))).alias("avg_mapq"))
