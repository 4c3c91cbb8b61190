"""Preference formatting with DataFrame functions only.

Two conversations, chosen and rejected, become one prompt and two completions.  The prompt is their
longest common prefix of turns, rendered once.  Each completion is the rendered rest of its conversation with
the character spans that a loss counts: the texts of assistant turns with their end marks.

Rows: a null text counts as empty and a null role as "unknown".  Turns are taken in the order
(turn, role, text), nulls first; turns that repeat stay.  A null pair id is a pair of its own.  Where both
sides are equal both completions are empty.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
TRAINED = "assistant"


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit(OPEN), t["role"], F.lit("\n"), t["text"], F.lit(CLOSE))), "")


def _spans(turns: Column) -> Column:
    """``start:end`` of the trained characters, comma separated, in the rendered turns."""
    size = lambda t: F.lit(len(OPEN) + 1 + len(CLOSE)) + F.length(t["role"]) + F.length(t["text"])
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s, t):
        begin = s["at"] + F.lit(len(OPEN) + 1) + F.length(t["role"])
        span = F.concat(begin.cast("string"), F.lit(":"), (s["at"] + size(t) - F.lit(1)).cast("string"))
        return F.struct((s["at"] + size(t)).alias("at"), F.when(t["role"] == TRAINED, F.array_append(s["out"], span)).otherwise(s["out"]).alias("out"))

    return F.array_join(F.aggregate(turns, none, step, lambda s: s["out"]), ",")


def format_preferences(turns: DataFrame) -> DataFrame:
    """``turns(pair_id, side, turn, role, text)``, side ``chosen`` or ``rejected``, to a row per pair.

    Columns: pair_id, prompt_turns, prompt, chosen, chosen_mask, rejected, rejected_mask.
    """
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("turn", "role", "text")))).alias(s)
    clean = turns.select("pair_id", "side", "turn", F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    both = clean.groupBy("pair_id").agg(side("chosen"), side("rejected"))
    same = F.zip_with("chosen", "rejected", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    both = both.withColumn("at_", F.array_position(same, False).cast("int"))
    both = both.withColumn("prompt_turns", F.when(F.col("at_") == 0, F.size("chosen")).otherwise(F.col("at_") - 1))
    rest = lambda s: F.slice(F.col(s), F.col("prompt_turns") + 1, F.size(s))
    both = both.withColumn("c_", F.when(F.size("chosen") > 0, rest("chosen")).otherwise(F.col("chosen")))
    both = both.withColumn("r_", F.when(F.size("rejected") > 0, rest("rejected")).otherwise(F.col("rejected")))
    prompt = F.when(F.col("prompt_turns") > 0, _rendered(F.slice(F.col("chosen"), 1, F.col("prompt_turns")))).otherwise(F.lit(""))
    return both.select("pair_id", "prompt_turns", prompt.alias("prompt"), _rendered(F.col("c_")).alias("chosen"), _spans(F.col("c_")).alias("chosen_mask"), _rendered(F.col("r_")).alias("rejected"), _spans(F.col("r_")).alias("rejected_mask"))


def stale_reply_pairs(conversations: DataFrame) -> DataFrame:
    """A pair for each conversation: as it is, and with its last reply replaced by the one before.

    The rejected side repeats an earlier reply where the last one belongs, or says nothing if there is no earlier
    reply.  A conversation without a reply is paired with itself.
    """
    c = conversations.select(F.col("conv_id").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("pair_id").orderBy("turn", "role", "text")
    reply = F.when(F.col("role") == TRAINED, F.col("text"))
    c = c.withColumn("before_", F.last(reply, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    after = F.count(reply).over(order.rowsBetween(1, Window.unboundedFollowing))
    c = c.withColumn("final_", (F.col("role") == TRAINED) & (after == 0))
    stale = F.when(F.col("final_"), F.coalesce("before_", F.lit(""))).otherwise(F.col("text"))
    sides = F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), stale.alias("text")))
    return c.select("pair_id", "turn", "role", F.explode(sides).alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")
