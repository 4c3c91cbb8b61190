"""Connected components by alternating large-star and small-star contraction.

Edges stay distributed.  Each round is a few key-wise minima and joins and is
written to the shared folder, so lost executors cost one round at most.  A vertex
with very many neighbours is pre-aggregated in the minima and split by AQE in the
joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import discard, stage


def _signature(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first()
    return tuple(row)


def _minima(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``edges(u, v)`` to ``(node, label)``, the label being the smallest reachable node.

    Nodes are longs.  Null ends and loops are ignored; repeated edges count once; no
    edges give no rows.  Only nodes that have an edge appear.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u") != F.col("v")).alias("ok"))
    e = stage(e.where("ok").select("u", "v").distinct(), "edges")
    before = _signature(e)
    for _ in range(rounds):
        if not before[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        turned = e.select(F.col("v").alias("u"), F.col("u").alias("w"))  # the larger neighbours of u
        large = turned.join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
        large = stage(large, "large")
        low = _minima(large)
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, stage(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        after = _signature(e)
        discard(old, large)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(roots)
