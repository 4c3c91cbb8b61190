"""Mixing sources to target weights.

Every document gets a hash-random key.  Within its source the keys are range-sorted:
the key space is cut into equal ranges, the words of each range are summed, the sums of the
ranges are accumulated, and each range is then sorted and accumulated by itself.  So no task
holds a source, however large.  A source's budget is cut exactly: whole epochs first, then the
documents in key order, the last of them in part.

Rows: the size of a null text is 0.  A null source is a source, the last one.  A null doc_id is
a document like any other.  Rows that repeat exactly are interchangeable, and each is mixed.
An empty table gives no rows.  With no words at all, every target is 0.  Other columns, whatever their
names, take no part and are carried along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import WORD, as_row, row_column, stage, unpacked

WEIGHTS = (5.0, 2.0, 1.0)
MOST = 3
#: Ranges of a source's key space.
RANGES = 4096


def sort_key(doc_id: Column, text: Column, seed: int) -> Column:
    """The hash-random key of a document."""
    return F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("long"), F.lit(-1)), text)


def sizes(docs: DataFrame, seed: int = 42) -> DataFrame:
    """``docs(doc_id, text, source)`` to (doc_id, source, size, key, bytes), a row per document."""
    size = F.when(F.col("text").isNull(), 0).otherwise(F.regexp_count("text", F.lit(WORD))).cast("long")
    key = sort_key(F.col("doc_id"), F.col("text"), seed)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), key.alias("key"))


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target): weights by rank of the source, capped, the excess reshared.

    The fixed point of resharing gives each source min(cap, level * weight).  With the sources in
    ascending order of cap / weight the capped ones are a prefix, so one pass of sums finds it.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*map(F.lit, weights))
    per = per.withColumn("w_", w[F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))])
    per = per.withColumn("cap_", F.lit(float(most)) * F.col("source_size"))
    order = Window.orderBy(F.col("cap_") / F.col("w_"), F.col("source").asc_nulls_last())
    before, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap_").over(before), F.lit(0.0))
    weight = F.sum("w_").over(every) - F.coalesce(F.sum("w_").over(before), F.lit(0.0))
    per = per.withColumn("level_", left / weight)
    # The first source, in this order, that the level leaves below its cap fixes the level.
    per = per.withColumn("open_", F.col("level_") * F.col("w_") <= F.col("cap_"))
    level = F.min(F.when(F.col("open_"), F.struct(F.col("cap_") / F.col("w_"), F.col("level_").alias("l")))).over(every)["l"]
    return per.select("source", "source_size", F.least("cap_", F.coalesce(level * F.col("w_"), F.col("cap_"))).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 42) -> DataFrame:
    """(doc_id, source, size, key, source_size, target, taken), a row per document."""
    sized = stage(sizes(docs, seed), "sizes")
    goal = stage(targets(sized, weights, most), "targets")
    cut = (F.shiftrightunsigned(F.col("key"), 52)).cast("int")  # RANGES equal ranges of the unsigned key
    ranged = sized.withColumn("range_", cut)
    sums = ranged.groupBy("source", "range_").agg(F.sum("size").alias("s_"))
    over = Window.partitionBy("source").orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("source_"), F.col("range_").alias("r_"), F.coalesce(F.sum("s_").over(over), F.lit(0)).alias("base_"))
    goal = goal.withColumnRenamed("source", "goal_")
    sums = sums.join(goal, F.col("source_").eqNullSafe(F.col("goal_"))).drop("goal_")
    inside = Window.partitionBy("source", "range_").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    own = ranged.withColumn("own_", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = own.join(sums, (F.col("range_") == F.col("r_")) & F.col("source").eqNullSafe(F.col("source_")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rows = rows.withColumn("epochs", F.least(epochs, F.lit(most)).cast("long"))
    rest = F.floor(F.col("target") + 0.5).cast("long") - F.col("epochs") * F.col("source_size")
    part = F.least(F.greatest(rest - F.col("base_") - F.col("own_"), F.lit(0)), F.col("size"))
    taken = F.col("epochs") * F.col("size") + F.when(F.col("epochs") < most, part).otherwise(F.lit(0))
    return rows.select("doc_id", "source", "size", "key", "source_size", "target", taken.cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = 42) -> DataFrame:
    """The documents of the mix: a row for each time a document is taken, with the columns of ``docs``.

    A document taken in part keeps its first words, up to the budget; ``n_chars``, if there, follows.
    """
    plan = mix(docs.select("doc_id", "text", "source"), weights, most, seed)
    # Rows that repeat exactly share a key; number them on both sides so that each meets its own plan.
    same = Window.partitionBy("doc_id", "source", "key").orderBy("taken")
    plan = plan.where("taken > 0").withColumn("number", F.row_number().over(same))
    plan = plan.select(F.struct(F.col("doc_id").alias("d"), "key", "number").alias("plan_at"), F.col("size").alias("plan_size"), F.col("taken").alias("plan_taken"))
    doc_id = row_column("doc_id").cast("long")
    mine = as_row(docs, key_=sort_key(F.col("doc_id"), F.col("text"), seed))
    number = F.row_number().over(Window.partitionBy(doc_id, row_column("source").cast("string"), "key_").orderBy(F.lit(0)))
    mine = mine.withColumn("number_", number)
    at = F.col("plan_at")
    rows = mine.join(plan, (F.col("key_") == at["key"]) & (F.col("number_") == at["number"]) & doc_id.eqNullSafe(at["d"]))
    whole = (F.col("plan_taken") / F.col("plan_size")).cast("int")
    rest = (F.col("plan_taken") - whole * F.col("plan_size")).cast("int")
    times = F.concat(F.array_repeat(F.lit(-1), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    rows = rows.select("row_", F.explode(times).alias("times_"))
    text = row_column("text")
    cut = F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, F.col("times_")), "")
    new = {"text": F.when(F.col("times_") < 0, text).otherwise(cut)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("times_") < 0, row_column("n_chars")).otherwise(F.length(new["text"]).cast(docs.schema["n_chars"].dataType))
    return unpacked(rows, docs.columns, **new)
