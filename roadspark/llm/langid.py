"""Language identification of mixed-language text: script ranges, per-word scores and Viterbi.

Training counts byte trigrams (A-Z lowered, words between spaces) by language over a bounded sample of
labelled documents. A word's score for a language is the sum of its trigrams' log probabilities; the
script of its letters, by ranges of code points, leaves only languages that were seen in that script
(all of them where none was). Viterbi with a switching penalty labels every word; lang_pred holds the
most words with letters, and score is its share.

Edge cases: null text, or text without a letter (no code point of a letter category: digits, marks and
symbols of any script are none), is ``und`` with score 0, as is everything when there is nothing to
learn from; words without letters take the language around them; ties fall to the smaller language;
rows that repeat a doc_id are labelled row by row; a null doc_id counts as the text '' for the held-out
rule; an empty table gives no rows; long texts are labelled whole. ``predict`` replaces columns named
lang_pred, score or spans; ``accepted`` keeps all columns as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernel as K
from ._spark import bounded_batches, partitions, table

#: About so many labelled documents of each language train the model; languages scored at a time.
SAMPLE, AT_ONCE = 2000, 16
BUCKETS, SWITCH, FOREIGN, SEEN = 1 << 15, 8.0, -1e9, 0.01
#: Ranges of code points by script: Latin, Greek, Cyrillic, Armenian, Hebrew, Arabic and Syriac, India's, Thai and Lao, Georgian, Hangul, kana, Han.
RANGES = [
    [(0x41, 0x24F), (0x1E00, 0x1EFF)], [(0x370, 0x3FF), (0x1F00, 0x1FFF)], [(0x400, 0x52F), (0x1C80, 0x1C8F)], [(0x530, 0x58F)], [(0x590, 0x5FF)],
    [(0x600, 0x8FF)], [(0x900, 0xDFF)], [(0xE00, 0xEFF)], [(0x10A0, 0x10FF)], [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)], [(0x3040, 0x30FF)], [(0x3400, 0x9FFF), (0x20000, 0x323AF)],
]
#: The last script holds letters of none of the ranges.
SCRIPTS = len(RANGES) + 1
_script: list[np.ndarray] = []


def script_table() -> np.ndarray:
    """The script of every code point that is a letter, -1 of others."""
    if not _script:
        table = np.full(0x110000, SCRIPTS - 1, np.int8)
        for k, ranges in enumerate(RANGES):
            for a, b in ranges:
                table[a : b + 1] = k
        table[~np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)] = -1
        _script.append(table)
    return _script[0]


def letters_of(data: np.ndarray) -> np.ndarray:
    """The script of the letter that starts at each byte of UTF-8 text, -1 where none does."""
    table = script_table()
    out = np.full(len(data), -1, np.int8)
    plain = data < 128
    out[plain] = table[data[plain]]
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        more = np.concatenate([data, np.zeros(3, np.uint8)])
        b0, b1, b2, b3 = (more[lead + k].astype(np.int64) for k in range(4))
        b1, b2, b3 = b1 & 63, b2 & 63, b3 & 63
        code = np.where(b0 < 0xE0, (b0 & 31) << 6 | b1, np.where(b0 < 0xF0, (b0 & 15) << 12 | b1 << 6 | b2, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3))
        out[lead] = table[np.minimum(code, 0x10FFFF)]
    return out


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 4 is 2."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _spaced(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows lowered, each with a space on both sides, and their offsets."""
    sizes = np.diff(offsets)
    out = np.full(len(data) + 2 * len(sizes), 32, np.uint8)
    shift = 2 * np.arange(len(sizes)) + 1
    out[np.arange(len(data)) + np.repeat(shift, sizes)] = K.LOWER[data]
    return out, np.concatenate([offsets[:-1] + 2 * np.arange(len(sizes)), [len(out)]])


def _grams(data: np.ndarray) -> np.ndarray:
    x = data.astype(np.uint32)
    x = (x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))
    x ^= x >> np.uint32(15)
    return (x * np.uint32(0x2C1B3C6D)) >> np.uint32(17)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each language of rows sorted by lang; only one language's table is held."""
    now, grams_seen, scripts_seen = None, np.zeros(BUCKETS, np.int64), np.zeros(SCRIPTS, np.int64)

    def counted() -> pa.RecordBatch:
        at = np.flatnonzero(grams_seen)
        values = [at.tobytes(), grams_seen[at].tobytes(), scripts_seen.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), *(pa.array([v], pa.binary()) for v in values)], names=["lang", "at", "grams", "scripts"])

    for batch in batches:
        for i, j, raw, at in K.chunks(batch["text"]):
            data, offsets = _spaced(raw, at)
            grams = _grams(data)
            start, end, bounds = K.words(data, offsets)
            script = np.maximum.reduceat(letters_of(data), start) if len(start) else np.zeros(0, np.int8)
            for k in range(i, j):
                lang = batch["lang"][k].as_py()
                if lang != now:
                    if now is not None:
                        yield counted()
                    now = lang
                    grams_seen[:], scripts_seen[:] = 0, 0
                lo, hi = offsets[k - i], offsets[k - i + 1] - 2
                grams_seen += np.bincount(grams[lo:hi], minlength=BUCKETS)
                own = script[bounds[k - i] : bounds[k - i + 1]]
                scripts_seen += np.bincount(own[own >= 0], minlength=SCRIPTS)
    if now is not None:
        yield counted()


class Model:
    """Languages, log probabilities [bucket, language] and the penalties [script, language]."""

    def __init__(self, langs: list[str], grams: np.ndarray, scripts: np.ndarray) -> None:
        self.langs = langs
        scores = np.empty((len(langs), BUCKETS))
        for k, row in enumerate(grams):
            scores[k] = np.log((row + 0.1) / (row + 0.1).sum())
        scores -= scores.mean(0)
        self.scores = np.ascontiguousarray(scores.T)
        used = scripts >= SEEN * np.maximum(1, scripts.sum(1, keepdims=True))
        self.foreign = np.where(used.any(0)[:, None] & ~used.T, FOREIGN, 0.0)


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from labelled rows that are not held out: text and lang alone."""
    bounded_batches(docs.sparkSession)
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    place = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 60)) / float(1 << 60)
    # one row for each language; a join, for thousands of them are too many for one expression
    sizes = rows.groupBy(F.col("lang").alias("l")).agg(F.least(F.lit(1.0), F.lit(float(sample)) / F.count("*")).alias("chance"))
    chosen = rows.join(F.broadcast(sizes), F.col("lang") == F.col("l")).where(place < F.col("chance")).select("lang", "text")
    # about sample rows a language; only the buckets that a language has come back
    counts = chosen.repartition(partitions(docs.sparkSession), "lang").sortWithinPartitions("lang").mapInArrow(_count, "lang string, at binary, grams binary, scripts binary").collect()
    if not counts:
        return None
    counts.sort(key=lambda r: r["lang"])

    def tables() -> Iterator[np.ndarray]:
        for r in counts:
            out = np.zeros(BUCKETS, np.int64)
            out[np.frombuffer(r["at"], np.int64)] = np.frombuffer(r["grams"], np.int64)
            yield out

    return Model([r["lang"] for r in counts], tables(), np.array([np.frombuffer(r["scripts"], np.int64) for r in counts]))


def viterbi(scores: np.ndarray, bounds: np.ndarray, penalty: float = SWITCH) -> np.ndarray:
    """The best label of every word; rows bounds[k]:bounds[k+1] are one text.

    A word whose first label leads by more than two penalties has it on every best path, for any other
    label would cost more than switching there and back. These words cut texts into pieces that are
    solved on their own, from the label before to the label after them; all pieces advance together.
    """
    n, m = scores.shape
    out = scores.argmax(1).astype(np.int16)
    if m < 2 or not n:
        return out
    two = np.partition(scores, m - 2, axis=1)
    free = two[:, -1] - two[:, -2] <= 2 * penalty
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    has = np.diff(bounds) > 0
    first[bounds[:-1][has]], last[bounds[1:][has] - 1] = True, True
    begin, end = free & first, free & last
    begin[1:] |= free[1:] & ~free[:-1]
    end[:-1] |= free[:-1] & ~free[1:]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    if not len(starts):
        return out
    by = np.argsort(starts - ends, kind="stable")
    starts, ends = starts[by], ends[by]
    sizes = ends - starts
    active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    stay, top = np.empty(scores.shape, bool), np.zeros(n, np.int16)
    best, every = np.zeros((len(sizes), m)), np.arange(len(sizes))
    after_label = every[~first[starts]]
    best[after_label] = -penalty
    best[after_label, out[starts[after_label] - 1]] = 0
    for t in range(int(sizes[0])):
        k = active[t]
        at, now = starts[:k] + t, best[:k]
        lead = now.argmax(1)
        limit = (now[every[:k], lead] - penalty)[:, None]
        stay[at], top[at] = now >= limit, lead
        best[:k] = np.maximum(now, limit) + scores[at]
    label = best.argmax(1).astype(np.int16)
    to_label = every[~last[ends - 1]]
    wanted = out[ends[to_label]]
    stays = best[to_label, wanted] >= best[to_label, label[to_label]] - penalty
    label[to_label] = np.where(stays, wanted, label[to_label])
    for t in range(int(sizes[0]) - 1, -1, -1):
        k = active[t]
        at, now = starts[:k] + t, label[:k]
        out[at] = now
        label[:k] = np.where(stay[at, now], now, top[at])
    return out


def label(column, model: Model | None) -> tuple[list[str], list[float], list[list[tuple[int, int, str]]]]:
    """(lang_pred, score, spans of words (first, last, lang)) of an Arrow string array."""
    preds, shares, spans = [], [], []
    # with many languages fewer bytes at a time, as a word has a score for each
    limit = K.LIMIT * AT_ONCE // max(AT_ONCE, len(model.langs) if model else 0)
    for i, j, raw, at in K.chunks(column, limit):
        data, offsets = _spaced(raw, at)
        start, end, bounds = K.words(data, offsets)
        if model is None or not len(start):
            preds += ["und"] * (j - i)
            shares += [0.0] * (j - i)
            spans += [[] for _ in range(j - i)]
            continue
        script = np.maximum.reduceat(letters_of(data), start)
        # reduceat runs on to the next word's start; only the space between is added, which has neither
        grams, scores = _grams(data), np.empty((len(start), len(model.langs)))
        for lo in range(0, len(model.langs), AT_ONCE):
            part = model.scores[:, lo : lo + AT_ONCE]
            sums = np.zeros((len(data) - 1, part.shape[1]))
            np.cumsum(part[grams], axis=0, out=sums[1:])
            scores[:, lo : lo + AT_ONCE] = sums[end - 1] - sums[start - 1]
        scores[script >= 0] += model.foreign[script[script >= 0]]
        scores[script < 0] = 0
        path = viterbi(scores, bounds)
        for k in range(j - i):
            own, real = path[bounds[k] : bounds[k + 1]], script[bounds[k] : bounds[k + 1]] >= 0
            if not real.any():
                preds.append("und")
                shares.append(0.0)
                spans.append([])
                continue
            counts = np.bincount(own[real], minlength=len(model.langs))
            preds.append(model.langs[int(counts.argmax())])
            shares.append(float(counts.max() / counts.sum()))
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1, [len(own)]]).tolist()
            spans.append([(a, b - 1, model.langs[own[a]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return preds, shares, spans


SPAN = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("lang", pa.string())]))


def predict(docs: DataFrame, model: Model | None, row: str | None = None) -> DataFrame:
    """docs with lang_pred, score and spans; only their text, or that of the struct ``row``, is looked at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            preds, shares, spans = label(batch[row].field("text") if row else batch["text"], model)
            spans = pa.array([[{"first": a, "last": b, "lang": x} for a, b, x in s] for s in spans], SPAN)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(preds, pa.string()), pa.array(shares, pa.float64()), spans], names=[*batch.schema.names, "lang_pred", "score", "spans"])

    out = docs.drop("lang_pred", "score", "spans")
    spans = T.ArrayType(T.StructType().add("first", "long").add("last", "long").add("lang", "string"))
    return out.mapInArrow(run, T.StructType([*out.schema.fields]).add("lang_pred", "string").add("score", "double").add("spans", spans))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: the predicted language of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.select("doc_id", "text", "lang"))
    rows = predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def accepted(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents with a language that holds at least that share of their words."""
    model = train(docs.select("doc_id", "text", "lang"))
    rows = predict(docs.select(F.struct(*docs.columns).alias("row")), model, "row")
    return rows.where((F.col("lang_pred") != "und") & (F.col("score") >= least)).select("row.*")
