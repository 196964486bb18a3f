"""Multi-party chat formatting by perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant
and the others as named users; the loss mask covers the assistant's own words. System turns belong to
nobody and are rendered as system turns in every perspective. A conversation is never gathered in one
row: each turn of each perspective is a segment with its place in that perspective's text, found by
two-level running sums (blocks of turns, then turns within a block).

Edge cases: a null role is the participant "unknown"; null text is empty; null turns come first; rows
that repeat a turn are ordered by role, then text, and all rendered; conversations of system turns
only have no perspective; an empty table gives no rows; marker strings inside texts are broken up, and
the characters of markers and line ends inside names are shown as _ (the columns perspective and speaker
keep them); a long text is one segment; a long conversation's turns are dealt by blocks of BLOCK turns;
other columns are left out, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import table

NOBODY = "system"
BLOCK = 256


def segments(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, speaker, rendered, start, mask_start, mask_end): code points from 0 in the perspective's text."""
    said = turns.select("conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    people = said.where(F.col("speaker") != NOBODY).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    name = F.when(own, "assistant").when(F.col("speaker") == NOBODY, NOBODY).otherwise(F.concat(F.lit("user:"), F.regexp_replace("speaker", r"[<|>\r\n]", "_")))
    head = F.concat(F.lit("<|"), name, F.lit("|>\n"))
    rows = said.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    rows = rows.select("conv_id", "perspective", "turn", "speaker", F.concat(head, "text", F.lit("<|end|>\n")).alias("rendered"), F.length(head).alias("head"), own.alias("own"))
    rows = rows.withColumn("size", F.length("rendered").cast("long")).withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 40))))
    keys = ["conv_id", "perspective", "block"]
    blocks = rows.groupBy(*keys).agg(F.sum("size").alias("block_size"))
    past = Window.partitionBy("conv_id", "perspective").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*(F.col(k).alias(f"_{k}") for k in keys), F.coalesce(F.sum("block_size").over(past), F.lit(0)).alias("base"))
    within = Window.partitionBy(*keys).orderBy("turn", "speaker", "rendered").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("perspective") == F.col("_perspective")) & (F.col("block") == F.col("_block"))
    start = F.col("base") + F.col("inner")
    return placed.join(blocks, same).select(
        "conv_id", "perspective", "turn", "speaker", "rendered", start.alias("start"),
        F.when(F.col("own"), start + F.col("head")).alias("mask_start"),
        F.when(F.col("own"), start + F.col("size") - 1).alias("mask_end"),
    )


def dialogues(turns: DataFrame) -> DataFrame:
    """(conv_id, perspective, text, masks): one row for each perspective, for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("start", "rendered", "mask_start", "mask_end")))
    rows = segments(turns).groupBy("conv_id", "perspective").agg(parts.alias("parts"))
    masks = F.transform(F.filter("parts", lambda p: p["mask_start"].isNotNull()), lambda p: F.struct(p["mask_start"].alias("start"), p["mask_end"].alias("end")))
    return rows.select("conv_id", "perspective", F.array_join(F.transform("parts", lambda p: p["rendered"]), "").alias("text"), masks.alias("masks"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every segment of every perspective of all conversations."""
    return segments(table(spark, sf_dir, "conversations"))


SQL = """
WITH said AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
people AS (SELECT DISTINCT conv_id AS c, speaker AS perspective FROM said WHERE speaker <> 'system'),
r AS (
  SELECT conv_id, perspective, turn, speaker, speaker = perspective AS own,
         '<|' || CASE WHEN speaker = perspective THEN 'assistant' WHEN speaker = 'system' THEN 'system' ELSE 'user:' || speaker END || '|>' || chr(10) AS head, text
  FROM said JOIN people ON conv_id IS NOT DISTINCT FROM c),
q AS (SELECT *, head || text || '<|end|>' || chr(10) AS rendered FROM r),
p AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, rendered
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM q)
SELECT conv_id, perspective, turn, speaker, rendered, start,
       CASE WHEN own THEN start + length(head) END AS mask_start, CASE WHEN own THEN start + length(rendered) - 1 END AS mask_end
FROM p
"""
