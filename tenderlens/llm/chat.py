"""Preference data from conversations: a shared prompt, and what was chosen and rejected after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Roles whose turns are trained on.
TRAINED = ("assistant",)


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END + "\n"))


def format_preferences(turns: DataFrame, pair: Column, chosen: Column, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns of paired conversations as segments of one prompt and two completions.

    `pair` names the pair that a row's conversation belongs to and `chosen` says on which side it is. The longest common turn
    prefix of both sides is the prompt and is given once; from the first turn in which the sides differ, each side's turns are
    its completion. One row per segment: pair_id, part (prompt, chosen, rejected), turn, role, segment (the turn in chat markup),
    train (true where a completion's turn has a trained role: prompts and other roles are masked), complete (both sides exist).
    Concatenated by turn, then role, then segment, the prompt and a completion are that side's whole conversation.

    Rows stay turns throughout: a conversation of any length never gathers in one row or task; the two shuffles are a grouping of
    equal turns and a join on a narrow table of the first difference. Rows repeated within a conversation count once; different
    rows of one turn all stay; a null turn comes before all others; null role and text are empty in the markup; a row whose pair is
    null belongs to no pair and is left out. If one side lacks a turn, that turn is a difference: of two equal conversations all is
    prompt, and a side that ends first has an empty completion. A pair with one side only has no prompt.
    """
    at = F.coalesce(F.col(turn).cast("bigint"), F.lit(-(2**63)))
    rows = turns.select(pair.alias("pair_id"), chosen.alias("is_chosen"), at.alias("at"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).where("pair_id IS NOT NULL AND is_chosen IS NOT NULL")
    sides = rows.groupBy("pair_id", "at", "turn", "role", "text").agg(F.max("is_chosen").alias("in_chosen"), F.max(~F.col("is_chosen")).alias("in_rejected"))
    differ = F.col("in_chosen") != F.col("in_rejected")
    first = sides.groupBy("pair_id").agg(F.min(F.when(differ, F.col("at"))).alias("first"), (F.max("in_chosen") & F.max("in_rejected")).alias("complete"))
    placed = sides.join(first, "pair_id")
    prompt = F.col("first").isNull() | (F.col("at") < F.col("first"))
    parts = F.when(prompt, F.array(F.lit("prompt"))).otherwise(F.concat(F.when(F.col("in_chosen"), F.array(F.lit("chosen"))).otherwise(F.array().cast("array<string>")), F.when(F.col("in_rejected"), F.array(F.lit("rejected"))).otherwise(F.array().cast("array<string>"))))
    exploded = placed.select("pair_id", F.explode(parts).alias("part"), "turn", "role", "text", "complete")
    train = F.coalesce((F.col("part") != "prompt") & F.col("role").isin(*TRAINED), F.lit(False))
    return exploded.select("pair_id", "part", "turn", "role", rendered(F.col("role"), F.col("text")).alias("segment"), train.alias("train"), "complete")


#: The same for the registered query: conversations 2 k (chosen) and 2 k + 1 (rejected) are a pair.
ORACLE = f"""
WITH rows_ AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 0 AS is_chosen, turn, role, text FROM conversations),
sides AS (SELECT pair_id, turn, role, text, max(is_chosen::INT) AS c, max((NOT is_chosen)::INT) AS r FROM rows_ GROUP BY ALL),
firsts AS (SELECT pair_id, min(CASE WHEN c <> r THEN turn END) AS first, max(c) = 1 AND max(r) = 1 AS complete FROM sides GROUP BY pair_id),
placed AS (SELECT s.*, f.complete, (f.first IS NULL OR s.turn < f.first) AS prompt FROM sides s JOIN firsts f ON s.pair_id = f.pair_id),
parts AS (
  SELECT pair_id, 'prompt' AS part, turn, role, text, complete FROM placed WHERE prompt
  UNION ALL SELECT pair_id, 'chosen', turn, role, text, complete FROM placed WHERE NOT prompt AND c = 1
  UNION ALL SELECT pair_id, 'rejected', turn, role, text, complete FROM placed WHERE NOT prompt AND r = 1)
SELECT pair_id, part, turn, role, '{START}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{END}' || chr(10) AS segment,
  coalesce(part <> 'prompt' AND role = 'assistant', false) AS train, complete
FROM parts
"""
