"""Chat formatting of preference pairs.

A pair is a chosen and a rejected conversation. Their longest common prefix of turns is
rendered once, as the prompt; what follows on either side is a completion, whose assistant
messages are trained on (``in_loss``) and whose other messages are masked.

Turns are compared where they stand: one row for each (pair, turn) holds both sides, so a
pair is never gathered, however many turns it has; the first turn that differs is a
minimum over the pair, joined back. Repeated rows count once. Several messages with one
turn number form one turn, ordered by role and text. Turns that one side lacks differ. A
null turn number comes first, as -1; a null role is ``unknown``; a null text is empty. Rows
without conversation id belong to no pair and are left out. A conversation without
counterpart is all completion, with ``paired`` false; equal conversations are all prompt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def format_preferences(turns: DataFrame, pair: Column, chosen: Column) -> DataFrame:
    """One row for each rendered message: pair_id, part, turn, message, role, rendered, in_loss, paired.

    ``pair`` names the pair of a row of ``turns`` (turn, role, text), ``chosen`` its side.
    ``part`` is prompt, chosen or rejected; ``message`` counts from 0 within a turn.
    """
    message = F.struct(F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = turns.select(pair.alias("pair_id"), F.coalesce(F.col("turn"), F.lit(-1)).cast("long").alias("turn"), chosen.alias("chosen"), message.alias("message")).where("pair_id IS NOT NULL").distinct()
    sides = rows.groupBy("pair_id", "turn").agg(F.sort_array(F.collect_list(F.when(F.col("chosen"), F.col("message")))).alias("a"), F.sort_array(F.collect_list(F.when(~F.col("chosen"), F.col("message")))).alias("b"))
    differs = F.col("a") != F.col("b")
    firsts = sides.groupBy("pair_id").agg(F.min(F.when(differs, F.col("turn"))).alias("first"), (F.max(F.size("a") > 0) & F.max(F.size("b") > 0)).alias("paired"))
    whole = sides.join(firsts, "pair_id")
    in_prompt = F.col("first").isNull() | (F.col("turn") < F.col("first"))

    def part(name: str, when: Column, messages: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("part"), messages.alias("messages")))

    parts = F.array_compact(F.array(part("prompt", in_prompt, F.col("a")), part("chosen", ~in_prompt, F.col("a")), part("rejected", ~in_prompt, F.col("b"))))
    each = whole.select("pair_id", "turn", "paired", F.explode(parts).alias("p")).select("pair_id", "turn", "paired", "p.part", F.posexplode("p.messages").alias("message", "m"))
    rendered = F.concat(F.lit("<|"), F.col("m.role"), F.lit("|>\n"), F.col("m.text"), F.lit("<|end|>\n"))
    return each.select("pair_id", "part", "turn", F.col("message").cast("long").alias("message"), F.col("m.role").alias("role"), rendered.alias("rendered"), ((F.col("part") != "prompt") & (F.col("m.role") == "assistant")).alias("in_loss"), "paired")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are pair k."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return format_preferences(turns, F.floor(F.col("conv_id") / 2).cast("long"), F.pmod(F.col("conv_id"), F.lit(2)) == 0)


OP3_SQL = r"""
WITH rows AS (
  SELECT DISTINCT floor(conv_id / 2)::BIGINT AS pair_id, coalesce(turn, -1)::BIGINT AS turn, conv_id % 2 = 0 AS chosen,
         coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (SELECT *, row_number() OVER (PARTITION BY pair_id, turn, chosen ORDER BY role, text) - 1 AS message FROM rows),
same AS (
  SELECT a.pair_id, a.turn, count(*) AS n FROM numbered a JOIN numbered b
    ON a.pair_id = b.pair_id AND a.turn = b.turn AND a.message = b.message AND a.role = b.role AND a.text = b.text AND a.chosen AND NOT b.chosen
  GROUP BY ALL),
size AS (SELECT pair_id, turn, count(*) FILTER (WHERE chosen) AS na, count(*) FILTER (WHERE NOT chosen) AS nb FROM numbered GROUP BY ALL),
firsts AS (
  SELECT pair_id, min(turn) FILTER (WHERE na <> nb OR coalesce(n, 0) <> na) AS first, max(na) > 0 AND max(nb) > 0 AS paired
  FROM size LEFT JOIN same USING (pair_id, turn) GROUP BY pair_id),
placed AS (SELECT *, CASE WHEN first IS NULL OR turn < first THEN 'prompt' WHEN chosen THEN 'chosen' ELSE 'rejected' END AS part FROM numbered JOIN firsts USING (pair_id))
SELECT pair_id, part, turn, message::BIGINT AS message, role, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered,
       part <> 'prompt' AND role = 'assistant' AS in_loss, paired
FROM placed WHERE part <> 'prompt' OR chosen
"""
