"""Mixing sources to target weights by capped water-filling.

Every source gets weight w; its target is min(cap * size, level * w), with the level at which the
targets add up to share * (all sizes): clamping sources at their maximum and resharing the excess by
weight until none is above. Then each document is taken ``whole`` times, and a seeded order of each
source's documents gives the fractional repetition: documents before the remaining target are taken
once more, the one on the border with the words that are left.

Edge cases: null text has size 0; null sources are one source, ordered last; sources without words
have target 0; rows that repeat a doc_id are rows of their own (in ``copies``, rows with equal doc_id,
source and text are repeated alike); ties in the seeded order fall by doc_id, size and text; long texts
are counted whole; an empty table gives no rows. ``copies`` keeps all columns as they are, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch, running_sum, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP, SEED, BINS = 1.5, 2.0, 7, 1024
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str | Column) -> Column:
    """The number of words, null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Adds target to rows (source, source_size, weight); each round is one aggregate of two numbers."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    ratio = F.col("source_size") * F.lit(cap) / F.col("weight")
    level, goal = -1.0, share * total
    while True:
        above = ratio > F.lit(level)
        held, free = sources.agg(
            F.coalesce(F.sum(F.when(~above, F.col("source_size") * F.lit(cap))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if not free:
            return sources.withColumn("target", F.col("source_size") * F.lit(cap))
        raised = (goal - held) / free
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.round(F.least(F.col("source_size") * F.lit(cap), F.col("weight") * F.lit(level)), 6))


def mix(docs: DataFrame, scratch: Scratch, seed: int = SEED, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Rows (doc_id, source, text_key, size, source_size, target, whole, extra, before, taken) of documents (doc_id, source, text)."""
    key = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f"|{seed}"))
    place = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    sized = docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), word_count("text").alias("size"), place.alias("place"))
    sized = scratch.keep(sized.withColumn("bin", F.floor(F.col("place") * BINS).cast("int")), "sized")
    bins = scratch.keep(sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size")), "bins")
    sources = bins.groupBy("source").agg(F.sum("bin_size").alias("source_size"))
    sources = running_sum(sources, [F.asc_nulls_last("source")], F.lit(1), "rank", scratch, "ranked")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS)).cast("int") + 1)
    sources = scratch.keep(sources.select("source", "source_size", weight.alias("weight")), "sources")
    filled = water_fill(sources, share, cap).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    filled = filled.withColumn("extra", F.floor(F.col("target") - F.col("whole") * F.col("source_size")))
    sums = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("bin_start", F.coalesce(F.sum("bin_size").over(sums), F.lit(0)))
    plan = bins.alias("b").join(filled.alias("s"), F.col("b.source").eqNullSafe(F.col("s.source"))).select("b.source", "bin", "bin_start", "source_size", "target", "whole", "extra")
    order = Window.partitionBy("source", "bin").orderBy("place", "doc_id", "size", "text_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(order), F.lit(0)))
    both = placed.alias("d").join(plan.alias("p"), F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.bin") == F.col("p.bin")))
    before = F.col("bin_start") + F.col("inner")
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("extra") - before))
    return both.select("d.doc_id", "d.source", "text_key", "size", "source_size", "target", "whole", "extra", before.alias("before"), (F.col("whole") * F.col("size") + more).cast("long").alias("taken"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: doc_id, size, source_size, target, taken."""
    return mix(table(spark, sf_dir, "documents"), Scratch(spark, "mixing")).select("doc_id", "size", "source_size", "target", "taken")


def copies(docs: DataFrame, scratch: Scratch, seed: int = SEED) -> DataFrame:
    """The mixed documents: every row as often as the mix repeats it, in whole repetitions (a fractional one counts from half of it)."""
    taken = mix(docs.select("doc_id", "source", "text"), scratch, seed)
    half = (F.col("taken") - F.col("whole") * F.col("size")) * 2 >= F.col("size")
    n = (F.col("whole") + (half & (F.col("size") > 0)).cast("int")).cast("int")
    times = taken.select("doc_id", "source", "text_key", n.alias("n")).groupBy("doc_id", "source", "text_key").agg(F.max("n").alias("n")).where("n > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("row.source").eqNullSafe(F.col("source")) & (F.xxhash64("row.text") == F.col("text_key"))
    return rows.join(times, same).select("row", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")).select("row.*")


SQL = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|{SEED}'), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::DOUBLE AS sz,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source),
r AS (
  SELECT *, 2 * sz / w AS ratio, sum(w) OVER (ORDER BY 2 * sz / w DESC) AS free_w,
         2 * sum(sz) OVER (ORDER BY 2 * sz / w) AS held_through, sum(sz) OVER () AS total,
         2 * sum(sz) OVER (PARTITION BY 2 * sz / w) AS held_own
  FROM s),
m AS (SELECT *, (1.5 * total - (held_through - held_own)) / free_w AS lam FROM r),
l AS (SELECT coalesce(arg_min(lam, ratio) FILTER (lam <= ratio), 'inf'::DOUBLE) AS level FROM m),
t AS (SELECT source, sz::BIGINT AS source_size, round(least(2 * sz, w * level), 6) AS target FROM s, l),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT *, floor(target - whole * source_size)::BIGINT AS extra FROM f)
SELECT d.doc_id, d.size, g.source_size, g.target,
       (whole * d.size + greatest(0, least(d.size, extra - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
"""
