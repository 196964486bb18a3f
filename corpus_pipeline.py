"""The corpus pipeline: language ID, quality, near duplicates, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All stages but the last return the columns of documents, as they are and
whatever their names. An empty table goes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from roadspark.llm import jaccard, langid, mixing, packing, quality
from roadspark.llm._spark import Scratch, released, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one main language. Texts that are null, empty or without a letter go; repeated rows are judged alike, and very long texts whole."""
    return langid.accepted(docs)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose shrunk quality reaches the threshold. Null source or lang is a site of its own; null and empty texts have the features of no words; rows at the threshold stay."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates: the smallest doc_id, one row of it. Texts without words all stay; rows without doc_id link by their text."""
    return jaccard.one_of_each(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents as the mix of sources takes them. Null sources are one source; texts without words are taken as often as their source's whole repetitions."""
    return mixing.copies(docs, Scratch(spark, "mixing"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mix into sequences, copies one after the other. Null and empty texts are their end token."""
    return packing.pack(docs)


STAGES = [("language ID", language), ("quality classifier", good), ("n-gram Jaccard join", unique), ("source mixing", mixed), ("packing", packed)]
#: SQL can't express the trained stages nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with released():
            docs = scratch.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
