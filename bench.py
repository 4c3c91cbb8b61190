"""Time the headline queries and the published case of the baseline; prints one JSON line.

The published case is one contig of 4.6 million bases: its index is built and saved, and 2,000 reads of 150 bases with 1 %
errors are mapped against the saved index.  The session is the one that the queries before it have warmed.
"""

import json
import os
import sys
import tempfile
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

HEADLINE = ["contig_table", "seed_join", "mem_islands", "best_hit", "strand_coverage", "kmer_counts", "chain_table", "align_reads", "coordinate_order", "bai_bins", "bai_linear", "sam_text", "cigar_spans", "mapping_quality", "union_coverage"]
BASES, READS, LENGTH = 4_600_000, 2000, 150


def main() -> None:
    from pyspark.sql import SparkSession, functions as F

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(2 * int(cpus))).config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "16m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from strandline.config import preset
    from strandline.operators import index, mapping
    from strandline.plans import catalog
    from strandline.sources import sequences as io
    from strandline.sources.staging import staged

    took, notes = {}, {}

    def timed(name, run):
        start = time.time()
        out = run()
        took[name] = round(time.time() - start, 3)
        print(name, took[name], file=sys.stderr, flush=True)
        return out

    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    sink(spark.read.parquet(f"{sf_dir}/nation.parquet"))  # start-up is not a query
    for name in os.environ.get("BENCH_ONLY", ",".join(HEADLINE)).split(","):
        if name:
            timed(name, lambda: sink(catalog.QUERIES[name](spark, sf_dir)))
    with tempfile.TemporaryDirectory() as folder:
        whole = io.random_sequences(spark, BASES // 10_000, 10_000, "11").orderBy("id")
        seq = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("id", "seq"))), lambda x: x["seq"]), "")
        refs = index.contigs(whole.agg(seq.alias("seq")).select(F.lit(0).cast("long").alias("ref_id"), F.lit("chr").alias("name"), "seq"))
        truth = staged(io.simulate(refs, READS, LENGTH, 0.01))
        timed("index_build_4.6_mb", lambda: index.save(refs, f"{folder}/index", 19))
        reads = truth.select("read_id", "name", "seq", "qual")
        mapped = timed("align_2000_x_150", lambda: staged(mapping.align_single(reads, index.opened(spark, f"{folder}/index"), preset("intractable"))))
        right = io.accuracy(mapped.withColumn("line_no", F.col("kind_ord")), truth).first()
    notes |= {"reads_per_second": round(READS / took["align_2000_x_150"], 1), "mapped": right["mapped"], "correct_pos": right["correct_pos"]}
    print(json.dumps({"metric": "headline query seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir, **notes}))


if __name__ == "__main__":
    main()
