"""Packing along a space-filling curve.

A document's tokens are counted into DIM hashed buckets (scaled to unit length); a fixed random
projection takes that vector to AXES dimensions, and the Hilbert index of the quantised point is its
key. Documents are dealt by ranges of (key, hash of doc_id), sorted, and laid end to end along the
curve; every SIZE tokens begin a new sequence, so only the last sequence is padded. Range sums, one
row for each range, give every range its place on the line, so no task sees more than its range.

Edge cases: null or empty text is the end token alone; rows that repeat a doc_id are packed one after
the other; null doc_id is packed like any other; equal keys are ordered by doc_id and ids; a long
document spans several sequences; columns other than doc_id and text are left out, so their names can't
clash; an empty table gives no rows.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import _kernel as K
from ._spark import Scratch, partitions, range_of, table

SIZE, END = 2048, 1
DIM, AXES, BITS = 256, 3, 12
#: Entries of a worker's caches of tokenised words.
CACHE = 500_000
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
PROJECTION = np.random.default_rng(11).standard_normal((DIM, AXES))


def vocabulary_path() -> str:
    """The public vocabulary of the contract."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def id_type(tokenizer: Tokenizer) -> type:
    """The smallest type that holds all ids."""
    return np.uint16 if max(tokenizer.get_vocab().values(), default=END) < 1 << 16 else np.uint32


class Words:
    """Tokenises text word by word, with caches.

    This vocabulary drops white space, and neither its normaliser nor its pre-tokeniser joins text
    across it, so a text's ids are those of its words, one after the other. A word of letters below
    U+0250 is split as the vocabulary's own pattern does and each part goes to its model; any other
    word goes to the tokenizer as it is. A vocabulary with other steps is given whole texts.
    """

    #: Fixed value: the pattern by which this vocabulary splits text.
    SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    #: Its normaliser and pre-tokenizer.
    STEPS = [
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": SPLIT.pattern}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    ]

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.type = id_type(self.tokenizer)
        self.code = "H" if self.type is np.uint16 else "I"
        steps = json.loads(self.tokenizer.to_str())
        self.by_word = [steps["normalizer"], steps["pre_tokenizer"]] == self.STEPS and all(t["content"].startswith("<|") for t in steps["added_tokens"])
        # bytes as the byte-level characters of the vocabulary: printable ones stand for themselves
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = iter(range(256, 512))
        self.chars = [chr(b) if b in plain else chr(next(other)) for b in range(256)]
        self.parts: dict[str, bytes] = {}
        self.words: dict[int, bytes] = {}

    def part(self, text: str) -> bytes:
        found = self.parts.get(text)
        if found is None:
            shown = text if text.isascii() and text.isalpha() else "".join(self.chars[b] for b in text.encode())
            found = array(self.code, [t.id for t in self.model.tokenize(shown)]).tobytes()
            if len(self.parts) >= CACHE:
                self.parts.clear()
            self.parts[text] = found
        return found

    def word(self, raw: bytes) -> bytes:
        text = raw.decode("utf-8", "replace")
        if "<|" in text or (not text.isascii() and max(text) >= "ɐ"):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.type).tobytes()
        # below U+0250 there is nothing to compose; letters and the marks behind them are what the pattern finds
        low = text.lower()
        if low.isalpha():
            return self.part(low)
        stem = low.rstrip(MARKS)
        if stem.isalpha():
            return self.part(stem) + self.part(low[len(stem) :])
        return b"".join(self.part(p) for p in self.SPLIT.findall(unicodedata.normalize("NFC", text).lower()))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids with the end token, offsets) of the rows of a chunk."""
        if not self.by_word:
            found = [[*self.tokenizer.encode(data[a:b].tobytes().decode("utf-8", "replace"), add_special_tokens=False).ids, END] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            return np.array([i for ids in found for i in ids], self.type), np.cumsum([0, *map(len, found)])
        start, end, bounds = K.words(data, offsets)
        n = len(offsets) - 1
        hashes = K.span_hashes(data, start, end)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        pieces = []
        for h, i in zip(distinct.tolist(), first.tolist(), strict=True):
            found = self.words.get(h)
            if found is None:
                found = self.word(data[start[i] : end[i]].tobytes())
                if len(self.words) >= CACHE:
                    self.words.clear()
                self.words[h] = found
            pieces.append(found)
        sizes = np.array([len(p) // np.dtype(self.type).itemsize for p in pieces], np.int64)
        pool, at = np.frombuffer(b"".join(pieces), self.type), np.cumsum(sizes) - sizes
        counts = sizes[inverse]
        total = np.concatenate([[0], np.cumsum(counts)])
        ends = total[bounds] + np.arange(n + 1)
        out = np.full(int(ends[-1]), END, self.type)
        spread = np.repeat(at[inverse] - total[:-1], counts) + np.arange(total[-1])
        place = np.arange(total[-1]) + np.repeat(np.arange(n), np.diff(total[bounds]))
        out[place] = pool[spread]
        return out, ends


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer points [rows, axes] with that many bits an axis."""
    x = points.astype(np.int64).T.copy()
    axes, q = len(x), 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(axes):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), 1 << (bits - 1)
    while q > 1:
        turn = np.where(x[-1] & q, turn ^ (q - 1), turn)
        q >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def keys(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The Hilbert key of each row's hashed token vector."""
    bucket = (ids.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    vectors = np.zeros((len(ends) - 1, DIM))
    for k in range(len(ends) - 1):
        vectors[k] = np.bincount(bucket[ends[k] : ends[k + 1]], minlength=DIM)
    vectors /= np.maximum(1e-12, np.linalg.norm(vectors, axis=1, keepdims=True))
    flat = 1 / (1 + np.exp(-2 * (vectors @ PROJECTION)))
    return hilbert(np.minimum((flat * (1 << BITS)).astype(np.int64), (1 << BITS) - 1))


_loaded: dict[str, Words] = {}


def _tokenise(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _loaded:
            _loaded[path] = Words(path)
        words = _loaded[path]
        for batch in batches:
            for i, j, data, offsets in K.chunks(batch["text"]):
                ids, ends = words(data, offsets)
                raw = [ids[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(i, j - i), pa.array(keys(ids, ends), pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(raw, pa.binary())], names=["doc_id", "key", "doc_tokens", "ids"])

    return run


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _cut(size: int, held: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, place = None, 0
        for batch in batches:
            rows = []
            for k in range(batch.num_rows):
                pid, doc = batch["pid"][k].as_py(), batch["doc_id"][k].as_py()
                if pid != here:
                    here, place = pid, batch["base"][k].as_py()
                ids = np.frombuffer(batch["ids"][k].as_py(), held).astype("<u4")
                done = 0
                while done < len(ids):
                    take = min(len(ids) - done, size - place % size)
                    rows.append((doc, done, take, zlib.crc32(ids[done : done + take].tobytes()), len(ids), place // size, place % size))
                    done += take
                    place += take
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)], names=names)

    return run


def pack(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """The pieces of all documents (doc_id, text) in sequences of that many tokens."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "packing")
    path = path or vocabulary_path()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenise(path), "doc_id long, key long, doc_tokens long, ids binary")
    spread = F.shiftleft("key", 63 - AXES * BITS - 1) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << (62 - AXES * BITS)))
    rows = scratch.keep(rows.withColumn("order", spread), "tokens")
    n = partitions(spark)
    marks = rows.select(F.col("order").cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.1 / n) if n > 1 else []
    pid = range_of(F.col("order"), sorted({int(x) for x in marks}))
    sums = rows.groupBy(pid.alias("pid")).agg(F.sum("doc_tokens").alias("n"))
    # one row for each range
    base = sums.select(F.col("pid").alias("p"), (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("base"))
    dealt = rows.withColumn("pid", pid).join(F.broadcast(base), F.col("pid") == F.col("p")).select("pid", "base", "order", "doc_id", "ids")
    return dealt.repartitionByRange(n, "pid").sortWithinPartitions("pid", "order", "doc_id", "ids").mapInArrow(_cut(size, id_type(Tokenizer.from_file(path))), PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: the pieces of all documents."""
    return pack(table(spark, sf_dir, "documents"))
