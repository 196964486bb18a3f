"""Document fingerprints: a Merkle tree over pieces, paragraphs and sections of every text.

Leaves are pieces: runs of words that end at a word whose hash is divisible by PIECE, or with the
paragraph, so an edit moves no piece but its own. Paragraphs are lines; sections are runs of lines
that end at a line whose digest is divisible by SECTION. The fingerprint writes the tree as text:

    root|section:paragraph.pieces,paragraph.pieces;section:paragraph.pieces...

root, section and paragraph are SHA-256 digests (128 bits, as hex) of the level below, a paragraph's of
its bytes, and pieces are 32-bit digests in a row. Equal roots mean equal texts; ``differing`` walks down
only the branches that differ. The likeness of two fingerprints is the Dice coefficient of their
pieces.

Edge cases: null text is empty; two empty texts are alike (1.0); null doc_id comes first; rows that
repeat a doc_id are ordered by text and follow each other; a single row is its own next document; an
empty table gives no rows; long texts are hashed whole, in bounded passes; columns other than doc_id and text
are left out, so their names can't clash.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _kernel as K
from ._spark import partitions, range_of, table

PIECE, SECTION = 4, 4
FIRST = -(1 << 63)


class Print:
    """One text's fingerprint and the sorted digests of its pieces."""

    __slots__ = ("counts", "pieces", "root", "size", "text")

    def __init__(self, text: str, root: str, pieces: np.ndarray) -> None:
        self.text, self.root, self.size = text, root, len(pieces)
        self.pieces, self.counts = np.unique(pieces, return_counts=True)


def alike(x: Print, y: Print) -> float:
    if x.root == y.root:
        return 1.0
    if not x.size or not y.size:
        return 0.0
    _, i, j = np.intersect1d(x.pieces, y.pieces, assume_unique=True, return_indices=True)
    return float(2 * np.minimum(x.counts[i], y.counts[j]).sum() / (x.size + y.size))


def likeness(one: str, other: str) -> float:
    """Of two fingerprints, from 0 to 1."""
    return alike(parsed(one), parsed(other))


def parsed(fingerprint: str) -> Print:
    root, _, rest = fingerprint.partition("|")
    leaves = "".join(p.partition(".")[2] for s in rest.split(";") for p in s.partition(":")[2].split(","))
    return Print(fingerprint, root, np.frombuffer(bytes.fromhex(leaves), ">u4"))


def differing(one: str, other: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of one's paragraphs that the other lacks, by digests; equal branches are not entered.

    Paragraphs that only moved, and what only the other has, are shown by the first place where the two
    part, so unequal roots always give a place.
    """
    a, b = (x.partition("|") for x in (one, other))
    if a[0] == b[0]:
        return []
    mine, theirs = ([s.partition(":") for s in x[2].split(";")] for x in (a, b))
    i, last = 0, 0
    while i < min(len(mine), len(theirs)) and mine[i][0] == theirs[i][0]:
        i += 1
    while last < min(len(mine), len(theirs)) - i and mine[-1 - last][0] == theirs[-1 - last][0]:
        last += 1
    rest = Counter(p.partition(".")[0] for _, _, s in theirs[i : len(theirs) - last] for p in s.split(","))
    out = []
    for at, (_, _, inside) in enumerate(mine[i : len(mine) - last], i):
        for j, p in enumerate(inside.split(",")):
            digest = p.partition(".")[0]
            if rest[digest]:
                rest[digest] -= 1
            else:
                out.append((at, j))
    if out:
        return out
    if i == len(mine):
        return [(i - 1, len(mine[-1][2].split(",")))]
    ours, others = mine[i][2].split(","), theirs[i][2].split(",") if i < len(theirs) else []
    j = 0
    while j < min(len(ours), len(others)) and ours[j] == others[j]:
        j += 1
    return [(i, j)]


def fingerprints(texts: list[str]) -> list[Print]:
    """The fingerprints of texts, vectorised over all of them."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    start, end, bounds = K.words(data, offsets)
    lines = np.concatenate([np.flatnonzero(data == 10), offsets])
    lines.sort()
    if len(start):
        last = K.span_hashes(data, start, end) % np.uint64(PIECE) == 0
        last[:-1] |= np.searchsorted(lines, start[1:], "right") > np.searchsorted(lines, end[:-1], "left")
        last[-1] = True
        stop = np.flatnonzero(last)
        begin = np.concatenate([[0], stop[:-1] + 1])
        at, digests = start[begin], (K.span_hashes(data, start[begin], end[stop]) >> np.uint64(32)).astype(">u4")
    else:
        at, digests = np.zeros(0, np.int64), np.zeros(0, ">u4")
    digits = digests.tobytes().hex()
    out = []
    first = np.searchsorted(at, offsets)
    for k, x in enumerate(raw):
        sections, sums, section, inside = [], [], hashlib.sha256(), []
        paragraphs = x.split(b"\n")
        places = offsets[k] + np.cumsum([0] + [len(p) + 1 for p in paragraphs])
        cut = (first[k] + np.searchsorted(at[first[k] : first[k + 1]], places)).tolist()
        for i, p in enumerate(paragraphs):
            own = hashlib.sha256(p).digest()
            section.update(own)
            inside.append(f"{own[:16].hex()}.{digits[8 * cut[i] : 8 * cut[i + 1]]}")
            if own[0] % SECTION == 0 or i + 1 == len(paragraphs):
                sums.append(section.digest())
                sections.append(f"{section.hexdigest()[:32]}:{','.join(inside)}")
                section, inside = hashlib.sha256(), []
        root = hashlib.sha256(b"".join(sums)).hexdigest()[:32]
        out.append(Print(f"{root}|{';'.join(sections)}", root, digests[first[k] : first[k + 1]]))
    return out


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, edit_section int, edit_paragraph int, edited_paragraphs int"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("edit_section", pa.int32()), ("edit_paragraph", pa.int32()), ("edited_paragraphs", pa.int32())])


def _rows(held: list[tuple]) -> pa.RecordBatch:
    """Of (pid, sentinel, doc_id, text) in order; each but the last has its next document behind it."""
    texts = [r[3] for r in held]
    prints = fingerprints(texts)
    takes = [k for k in range(len(held) - 1) if not held[k][1]]
    edited = []
    for k in takes:
        need = len(texts[k]) // 4
        edited.append(texts[k][: len(texts[k]) - need] + texts[k + 1][:need])
    after = fingerprints(edited)
    places = [differing(e.text, prints[k].text) for k, e in zip(takes, after, strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([held[k][2] for k in takes], pa.int64()), pa.array([len(texts[k]) for k in takes], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
            pa.array([prints[k].text for k in takes], pa.string()), pa.array([e.text for e in after], pa.string()),
            pa.array([alike(prints[k], e) for k, e in zip(takes, after, strict=True)], pa.float64()),
            pa.array([alike(prints[k], prints[k + 1]) for k in takes], pa.float64()),
            pa.array([p[0][0] if p else None for p in places], pa.int32()), pa.array([p[0][1] if p else None for p in places], pa.int32()), pa.array([len(p) for p in places], pa.int32()),
        ],
        schema=ARROW,
    )


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for k in range(batch.num_rows):
            text = batch["text"][k].as_py()
            held.append((batch["pid"][k].as_py(), batch["sentinel"][k].as_py(), batch["doc_id"][k].as_py(), text))
            size += len(text)
            if size >= K.LIMIT:
                yield _rows(held)
                held, size = held[-1:], len(text)
    if len(held) > 1:
        yield _rows(held)


def with_next(docs: DataFrame) -> DataFrame:
    """op2's rows for documents (doc_id, text).

    One range shuffle of the texts by explicit bounds; the first document of each range also goes to
    the range before it, as a sentinel. Bounds and sentinels are one row for each range.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(FIRST))
    n = partitions(spark)
    marks = docs.select(key.cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.2 / n) if n > 1 else []
    pid = range_of(key, sorted({int(x) for x in marks}))
    rows = docs.select(pid.alias("pid"), F.lit(False).alias("sentinel"), key.alias("k"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    firsts = sorted(tuple(r) for r in rows.groupBy("pid").agg(F.min("k")).collect())
    if not firsts:
        return spark.createDataFrame([], SCHEMA)
    before = spark.createDataFrame([(firsts[i][0], firsts[(i + 1) % len(firsts)][1]) for i in range(len(firsts))], "pid int, k long")
    heads = rows.where(key.isin([k for _, k in firsts])).groupBy("k").agg(F.min("text").alias("text"))
    sentinels = heads.join(F.broadcast(before), "k").select("pid", F.lit(True).alias("sentinel"), "k", F.lit(None).cast("long").alias("doc_id"), "text")
    dealt = rows.unionByName(sentinels).repartitionByRange(n, "pid").sortWithinPartitions("pid", "sentinel", "k", "text")
    return dealt.select("pid", "sentinel", "doc_id", "text").mapInArrow(_walk, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the fingerprints of all documents, of their edited texts, and their likeness."""
    return with_next(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text"))
