"""License scan: an exact set-similarity join of license templates with the lines of every text, and with
runs of words that go on over line ends.

A template is a set of words; a line holds it when it has at least THRESHOLD of them. Words are
ordered by their frequency over the whole corpus (rarest first). Of a template's t words, at least
need = ceil(THRESHOLD * t) must occur, so one of its t - need + 1 rarest does (prefix filter); a line
of fewer than need distinct words is out (length filter); a first hit at place i leaves at most t - i
words (positional filter). What is left is verified exactly. A notice that is wrapped over several lines is
found in any SPAN * n words in a row, n the words of the template; this adds to the lines' hits, which
are those of SQL. Base phrases are found as consecutive words of the whole text. DataFrame functions
only; the templates are the only thing broadcast.

Edge cases: null text is empty; texts without a hit have empty labels, null places and score 0; an
empty table gives no rows; rows that repeat a doc_id are scanned row by row.
"""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import table

THRESHOLD = 0.8
#: A wrapped notice lies within so many times its template's words.
SPAN = 2
#: Base phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Well-known license notices and their labels.
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("lgpl", "licensed under the gnu lesser general public license version 3"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("reserved", "copyright all rights reserved"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lowered(text: str) -> Column:
    return F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)


def word_list(text: Column) -> Column:
    return F.filter(F.split(text, GAP), lambda w: w != "")


def template_index(lines: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> list[tuple]:
    """(word, label, template number, words, need, place) of every template's prefix, rarest words first."""
    sets = [(label, set(text.split())) for label, text in templates]
    vocabulary = sorted(set().union(*(s for _, s in sets)))
    # one row for each word of the templates comes back, whatever the size of the corpus
    seen = dict(lines.select(F.explode(F.split("line", GAP)).alias("w")).where(F.col("w").isin(vocabulary)).groupBy("w").count().collect())
    out = []
    for number, (label, words) in enumerate(sets):
        order = sorted(words, key=lambda w: (seen.get(w, 0), w))
        need = math.ceil(threshold * len(order) - 1e-9)
        out += [(w, label, number, order, need, place) for place, w in enumerate(order[: len(order) - need + 1])]
    return out


def template_hits(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, block, label, containment) of every line that holds a template."""
    text = docs.select("doc_id", F.xxhash64("text").alias("text_key"), lowered("text").alias("line"))
    index = docs.sparkSession.createDataFrame(template_index(text, templates, threshold), "word string, label string, number int, words array<string>, need int, place int")
    lines = text.select("doc_id", "text_key", F.posexplode(F.split("line", "\n")).alias("block", "line"))
    tokens = lines.select("doc_id", "text_key", "block", F.split("line", GAP).alias("has")).select("*", F.explode("has").alias("word"))
    found = tokens.join(F.broadcast(index), "word").where((F.size("has") >= F.col("need")) & (F.size("words") - F.col("place") >= F.col("need")))
    shared = F.size(F.array_intersect("words", "has"))
    return found.where(shared >= F.col("need")).select("doc_id", "text_key", "block", "label", (shared / F.size("words")).alias("containment"))


def wrapped_hits(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_key, label, containment) of every text of several lines that holds a template within SPAN times its words."""
    sets = [(label, sorted(set(text.split())), SPAN * len(text.split())) for label, text in templates]
    notices = docs.sparkSession.createDataFrame([(label, words, math.ceil(threshold * len(words) - 1e-9), span) for label, words, span in sets], "label string, words array<string>, need int, span int")
    vocabulary = sorted(set().union(*(words for _, words, _ in sets)))
    placed = F.transform(word_list(F.col("t")), lambda w, i: F.struct(w.alias("w"), i.alias("at")))
    marks = F.filter(placed, lambda x: x["w"].isin(vocabulary)).alias("marks")
    # of any t - need + 1 words of a template one must occur: its longest are seldom found, and cheap to look for
    rare = sorted({w for _, words, _ in sets for w in sorted(words, key=lambda w: (-len(w), w))[: len(words) - math.ceil(threshold * len(words) - 1e-9) + 1]})
    could = F.exists(F.array(lowered("text")), lambda t: functools.reduce(operator.or_, [F.contains(t, F.lit(w)) for w in rare]))
    text = docs.where(F.contains("text", F.lit("\n")) & could).select("doc_id", F.xxhash64("text").alias("text_key"), lowered("text").alias("t"))
    maybe = text.select("doc_id", "text_key", marks).join(F.broadcast(notices), F.size(F.array_intersect("words", "marks.w")) >= F.col("need"))
    own = F.filter("marks", lambda x: F.array_contains("words", x["w"]))

    def most(marks: Column) -> Column:
        def shared(x: Column, k: Column) -> Column:
            near = F.filter(F.slice(marks, k + 1, F.col("span")), lambda y: y["at"] < x["at"] + F.col("span"))
            return F.size(F.array_distinct(near["w"]))

        return F.array_max(F.transform(marks, shared))

    # as a lambda's argument, own is found once for a text and not once for each of its words
    best = maybe.select("doc_id", "text_key", "label", "words", "need", F.transform(F.array(own), most)[0].alias("best"))
    return best.where("best >= need").select("doc_id", "text_key", "label", (F.col("best") / F.size("words")).alias("containment"))


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: places of the base phrases, labels and score."""
    text = docs.select("doc_id", F.xxhash64("text").alias("text_key"), lowered("text").alias("t"))
    phrases = [(p.split(), label) for p, label in PHRASES.items()]
    maybe = F.col("t").rlike("|".join(GAP.join(p) for p, _ in phrases))
    words = word_list(F.col("t"))
    near = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"), F.slice(words, F.lit(3), F.size(words)).alias("c"))

    def hit(x: Column, i: Column) -> Column:
        out = F.lit(None)
        for phrase, label in phrases:
            same = x["a"] == phrase[0]
            for k, w in enumerate(phrase[1:], 1):
                same &= x["abc"[k]] == w
            out = F.when(same, F.struct(i.cast("long").alias("at"), F.lit(label).alias("label"))).otherwise(out)
        return out

    hits = F.when(maybe, F.filter(F.transform(near, hit), lambda x: x.isNotNull()))
    base = text.select("doc_id", "text_key", F.regexp_count("t", F.lit(WORD)).cast("long").alias("n_words"), hits.alias("hits"))
    found = template_hits(docs).drop("block").union(wrapped_hits(docs))
    more = found.groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    more = more.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "more", "containment")
    rows = base.join(more, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")), "left")
    n_base = F.coalesce(F.size("hits"), F.lit(0))
    none = F.array().cast("array<string>")
    base_labels = F.coalesce(F.array_sort(F.array_distinct("hits.label")), none)
    score = F.greatest(F.coalesce("containment", F.lit(0.0)), F.when(n_base > 0, 1.0).otherwise(0.0))
    return rows.select(
        "doc_id", "n_words", F.greatest(n_base, F.lit(0)).cast("long").alias("n_base"),
        F.array_min("hits.at").alias("first_word"), F.array_max("hits.at").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_labels, F.coalesce("more", none))), ",").alias("labels"), score.alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the scan of all documents."""
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    listed = ", ".join("('{}', [{}])".format(label, ", ".join(f"'{w}'" for w in sorted(set(text.split())))) for label, text in TEMPLATES)
    places = " UNION ALL ".join(
        f"SELECT r, i - 1 AS pos, '{label}' AS label FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) WHERE " + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split())) for phrase, label in PHRASES.items()
    )
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t, regexp_extract_all(t, '{WORD}') AS w FROM documents),
hits AS ({places}),
base AS (SELECT r, count(*)::BIGINT AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS bl FROM hits GROUP BY r),
lines AS (SELECT r, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), '{WORD}')) AS has FROM d),
templates(label, words) AS (VALUES {listed}),
more AS (
  SELECT r, list(DISTINCT label) AS ml, max(c) AS c
  FROM (SELECT r, label, len(list_intersect(words, has))::DOUBLE / len(words) AS c FROM lines, templates) WHERE c >= {THRESHOLD} GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(bl), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(coalesce(bl, []) || coalesce(ml, []))), ',') AS labels,
       greatest(coalesce(c, 0), CASE WHEN n_base > 0 THEN 1 ELSE 0 END)::DOUBLE AS score
FROM d LEFT JOIN base USING (r) LEFT JOIN more USING (r)
"""


SQL = _sql()
