"""Preference formatting of chosen and rejected conversations, with DataFrame functions only.

The longest common prefix of turns is rendered once, as the prompt; what follows in either conversation is rendered as
its completion. The result has one row per rendered turn with its place in the string, so that conversations of any
length stay in rows: the prompt, then `chosen` and `rejected`, both of which continue at the prompt's end. Only
assistant turns of a completion are to be learned (`trainable`); everything else is masked.

Turns are ordered by number, then role, then text, null first; repeated rows are turns of their own. A null role or text
is rendered as an empty one, but differs from it in the comparison. Where a completion has no turn (equal conversations,
or one is the beginning of the other), `usable` is false. Pairs with one side only have an empty prefix. An empty table
gives no rows. Turns without a pair id form one pair, with a null id. Any further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURN = ("turn", "role", "text")


def _beside(rows: DataFrame, more: DataFrame, how: str = "inner") -> DataFrame:
    """Join on pair_id, a null id being an id like any other."""
    more = more.withColumnRenamed("pair_id", "__pair")
    return rows.join(more, F.col("pair_id").eqNullSafe(F.col("__pair")), how).drop("__pair")


def rendered(role: str = "role", text: str = "text"):
    """One turn in the chat template; control marks inside a text lose their meaning."""
    body = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), F.coalesce(role, F.lit("")), F.lit("\n"), body, F.lit("<|im_end|>\n"))


def preference_rows(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both sides have pair_id, turn, role, text."""
    order = Window.partitionBy("pair_id", "side").orderBy(*TURN)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sides = chosen.select("pair_id", *TURN, F.lit("chosen").alias("side")).unionByName(
        rejected.select("pair_id", *TURN, F.lit("rejected").alias("side")))
    sides = sides.withColumn("rendered", rendered()).withColumns({
        "no": F.row_number().over(order).cast("long"), "n_chars": F.length("rendered").cast("long")})
    sides = sides.withColumn("start_char", F.coalesce(F.sum("n_chars").over(before), F.lit(0)))
    same = F.sha2(F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).cast("binary"), 256)
    marks = sides.select("pair_id", "no", "side", same.alias("mark")).groupBy("pair_id", "no").agg(
        *[F.max(F.when(F.col("side") == s, F.col("mark"))).alias(s) for s in ("chosen", "rejected")])
    ends = marks.groupBy("pair_id").agg(
        F.coalesce(F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), F.col("no"))), F.max("no") + 1).alias("first"),
        F.count("chosen").alias("n_chosen"), F.count("rejected").alias("n_rejected"))
    ends = ends.select("pair_id", (F.col("first") - 1).alias("prefix_turns"),
                       ((F.col("n_chosen") >= F.col("first")) & (F.col("n_rejected") >= F.col("first"))).alias("usable"))
    shared = F.col("no") <= F.col("prefix_turns")
    return _beside(sides, ends).where(~shared | (F.col("side") == "chosen")).select(
        "pair_id", F.when(shared, F.lit("prompt")).otherwise(F.col("side")).alias("part"), "no", "role", "rendered",
        "start_char", "n_chars", (~shared & (F.coalesce("role", F.lit("")) == "assistant")).alias("trainable"),
        "prefix_turns", "usable")


def stale_replies(turns: DataFrame) -> DataFrame:
    """A rejected version of each conversation: its last assistant turn repeats the reply before (or is empty)."""
    replies = turns.where("role = 'assistant'").groupBy("pair_id").agg(F.max("turn").alias("last"))
    marked = _beside(turns, replies, "left")
    earlier = marked.where("role = 'assistant' and turn < last").groupBy("pair_id").agg(
        F.max(F.struct("turn", "text"))["text"].alias("reply"))
    stale = (F.col("role") == "assistant") & (F.col("turn") == F.col("last"))
    return _beside(marked, earlier, "left").select(
        "pair_id", "turn", "role", F.when(stale, F.coalesce("reply", F.lit(""))).otherwise(F.col("text")).alias("text"))
