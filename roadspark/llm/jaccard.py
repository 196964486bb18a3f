"""N-gram Jaccard join with several global token orders, and the components of its links.

A document is the set of its 5-word shingles (64-bit hashes). Two documents link when
100 * |intersection| >= 80 * |union|. Documents with equal sets are one class (grouped by a 128-bit
digest), represented by their smallest doc_id. Of a set of n tokens, at least ceil(0.8 n) are shared
with any partner, so under every global order of tokens the partners share one of their first
n - ceil(0.8 n) + 1 tokens. Three orders filter candidates, and only their intersection is verified:

1. rare first: tokens found often within windows of the corpus come last, by their counts, the rest
   by hash. Its prefixes are joined as postings, with the length filter and, for the first common
   token, the positional filter.
2., 3. two orders by other hashes: a pair must share a token of both prefixes. They are kept as
   bitmaps of 256 bits, which never miss a shared token.

No posting list emits all its pairs: its members are first held against a few members of its largest
component, in rounds, and only pairs across components are left for the last round, each with a
member outside its list's largest component. These are all verified, so no link between different
components is lost. The result does not depend on which tokens count as frequent, nor on the hubs.

Edge cases: null or wordless text has the empty set, size 0, and its own component; fewer than five
words make one shingle; rows that repeat a doc_id count as one document with the links of all its
rows; rows without doc_id link like any text (equal ones count as one document), and report the
smallest doc_id of their component, null where there is none; columns other than doc_id and text are
left out, so their names can't clash; long texts are read whole; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _kernel as K
from ._spark import Scratch, components, partitions, table

WIDTH, PERCENT = 5, 80
#: Tokens of one window of the corpus, the count from which a token of it is frequent, and the most frequent tokens kept.
WINDOW, OFTEN, MOST = 1 << 22, 2, 1 << 18
#: Words of an order's bitmap, and bits (a power of two) of the filter of documents to verify.
BITMAP, FILTER_BITS = 4, 1 << 24
GROUP = 64
#: Members of a list's largest component that the others are held against, by round, before all pairs that are left.
HUBS = (1, 8)

PASS1 = "kind int, doc_id long, n long, d1 long, d2 long, sig array<long>, unnamed boolean"
POSTING = "token long, node long, n int, pos int"


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - (percent * n + 99) // 100 + 1


def _bitmap(tokens: np.ndarray, order: int, percent: int) -> list[int]:
    p = prefix_length(len(tokens), percent)
    keys = K.mix(tokens, order)
    if p < len(keys):
        keys = np.partition(keys, p - 1)[:p]
    bits = np.zeros(BITMAP, np.uint64)
    at = keys & np.uint64(64 * BITMAP - 1)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return K.signed(bits).tolist()


def _digests(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.bool_()]
        names = ["kind", "doc_id", "n", "d1", "d2", "sig", "unnamed"]
        window, held, seen = [], 0, set()

        def frequent() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(window), return_counts=True)
            tokens, counts = K.signed(tokens[counts >= OFTEN]), counts[counts >= OFTEN]
            none = [None] * len(tokens)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(([1] * len(tokens), none, counts, tokens, none, none, none), types, strict=True)], names=names)

        for batch in batches:
            for i, j, data, offsets in K.chunks(batch["text"]):
                sets = K.shingle_sets(data, offsets, width)
                d1 = [int(K.mix(s, 11).sum(dtype=np.uint64)) - (1 << 63) for s in sets]
                d2 = [int(K.mix(s, 12).sum(dtype=np.uint64)) - (1 << 63) for s in sets]
                sigs = [_bitmap(s, 2, percent) + _bitmap(s, 3, percent) if len(s) else None for s in sets]
                columns = ([0] * len(sets), batch["doc_id"].slice(i, j - i), [len(s) for s in sets], d1, d2, sigs, batch["unnamed"].slice(i, j - i))
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)
                for s, d in zip(sets, d1, strict=True):
                    if len(s) and d not in seen:
                        seen.add(d)
                        window.append(s)
                        held += len(s)
                if held >= WINDOW:
                    yield frequent()
                    window, held, seen = [], 0, set()
        if window:
            yield frequent()

    return run


def _postings(tokens: np.ndarray, ranks: np.ndarray, width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            for _, _, data, offsets in K.chunks(batch["text"]):
                out = []
                for s in K.shingle_sets(data, offsets, width):
                    if not len(s):
                        continue
                    node = int(K.mix(s, 11).sum(dtype=np.uint64)) - (1 << 63)
                    if node in seen:
                        continue
                    if len(seen) < 1 << 18:  # only spares repeated work
                        seen.add(node)
                    order = K.mix(s, 1) >> np.uint64(8)
                    if len(tokens):
                        at = np.minimum(np.searchsorted(tokens, s), len(tokens) - 1)
                        order |= np.where(tokens[at] == s, ranks[at], 0).astype(np.uint64) << np.uint64(56)
                    p = prefix_length(len(s), percent)
                    first = np.argpartition(order, p - 1)[:p] if p < len(s) else np.arange(len(s))
                    first = first[np.argsort(order[first])]
                    out.append((K.signed(s[first]), np.full(p, node), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["token", "node", "n", "pos"])

    return run


def _verify(width: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the sets of all rows of the key's doc_id
        key, against = None, []
        for batch in batches:
            a, b = [], []
            for i, _, data, offsets in K.chunks(batch["text"]):
                for k, s in enumerate(K.shingle_sets(data, offsets, width), i):
                    now, other = (batch["key"][k].as_py(), batch["salt"][k].as_py()), batch["doc_id"][k].as_py()
                    if not batch["role"][k].as_py():
                        if now != key:
                            key, against = now, []
                        if not any(np.array_equal(s, x) for x in against):
                            against.append(s)
                    elif now == key:
                        for x in against:
                            both = len(np.intersect1d(x, s, assume_unique=True))
                            if 100 * both >= percent * (len(x) + len(s) - both):
                                a.append(key[0])
                                b.append(other)
                                break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


class Join:
    """The join of one corpus: classes, postings, verified links and components."""

    def __init__(self, docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> None:
        self.spark, self.width, self.percent = docs.sparkSession, width, percent
        # rows without doc_id go by a hash of their text
        self.docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("doc_id"), "text", F.col("doc_id").isNull().alias("unnamed"))
        self.scratch = Scratch(self.spark, "jaccard")
        found = self.scratch.keep(self.docs.mapInArrow(_digests(width, percent), PASS1), "digests")
        self.sets = found.where("kind = 0").drop("kind")
        self.often = self._frequent(found.where("kind = 1").groupBy("d1").agg(F.sum("n").alias("n")))
        best = self.sets.where("n > 0").groupBy("d1", "d2", "n").agg(F.min(F.struct("doc_id", "sig")).alias("m"), F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
        self.classes = self.scratch.keep(best.select(F.col("d1").alias("node"), "d2", "n", "rep", F.col("m.sig").alias("sig"), "copies"), "classes")

    def _frequent(self, counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, counts) of the most frequent tokens: all from the smallest count that at most MOST tokens reach.

        That count comes from a histogram of at most 1,024 rows, so no more than MOST rows reach the
        driver; any choice of tokens gives the same links.
        """
        counts = self.scratch.keep(counts, "counts")
        step = F.floor(F.log2("n") * 16).cast("int")
        held, least = 0, None
        for k, n in sorted(counts.groupBy(step.alias("k")).count().collect(), reverse=True):
            held += n
            if held > MOST:
                break
            least = k
        rows = counts.where(step >= least).toPandas() if least is not None else None
        if rows is None:
            return np.zeros(0, np.uint64), np.zeros(0)
        return rows["d1"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.float64)

    def postings(self) -> DataFrame:
        """The tokens of first-order prefixes, once a class, where a class of the token's next smaller or larger size passes the length filter."""
        tokens, counts = self.often
        ranks = np.minimum(255, 1 + 16 * np.log2(np.maximum(1, counts / OFTEN))).astype(np.uint64)
        by = np.argsort(tokens)
        raw = self.docs.select("text").mapInArrow(_postings(tokens[by], ranks[by], self.width, self.percent), POSTING)
        by_size = Window.partitionBy("token").orderBy("n", "node")
        once = raw.withColumn("before", F.lag("node").over(by_size)).where("before is null or before <> node").drop("before")
        beside = once.withColumn("below", F.lag("n").over(by_size)).withColumn("above", F.lead("n").over(by_size))
        fits = (F.col("below") * 100 >= F.col("n") * self.percent) | (F.col("n") * 100 >= F.col("above") * self.percent)
        return self.scratch.keep(beside.where(fits).drop("below", "above"), "postings")

    def mixed(self, postings: DataFrame, comp: DataFrame, tag: int) -> DataFrame:
        """The postings of tokens found in several components, with their component, copies and the token's largest component (main)."""
        label = self.classes.join(comp.withColumnRenamed("node", "r"), F.col("rep") == F.col("r"), "left").groupBy("node").agg(F.min(F.coalesce("comp", "rep")).alias("comp"), F.max("copies").alias("copies"))
        lists = self.scratch.keep(postings.join(label, "node"), f"labelled-{tag}")
        groups = lists.groupBy("token", "comp").agg(F.count("*").alias("c"), F.max("copies").alias("most"))
        several = groups.groupBy("token").agg(F.max(F.struct("c", "most", "comp")).alias("m"), F.count("*").alias("k")).where("k > 1").select("token", F.col("m.comp").alias("main"))
        found = self.scratch.keep(lists.join(several, "token"), f"lists-{tag}")
        self.scratch.drop(f"labelled-{tag}")
        return found

    def candidates(self, pairs: DataFrame) -> DataFrame:
        """Distinct (x, y) nodes -> (ra, rb) representatives that pass the length filter and share both other prefixes."""
        left = self.classes.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("rep").alias("rx"), F.col("sig").alias("sx"))
        right = self.classes.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("rep").alias("ry"), F.col("sig").alias("sy"))
        shared = [F.lit(False), F.lit(False)]
        for k in range(2 * BITMAP):
            shared[k // BITMAP] |= F.col("sx")[k].bitwiseAND(F.col("sy")[k]) != 0
        fits = F.least("nx", "ny") * 100 >= F.greatest("nx", "ny") * self.percent
        rows = pairs.join(left, "x").join(right, "y").where(fits & shared[0] & shared[1])
        return rows.select(F.least("rx", "ry").alias("ra"), F.greatest("rx", "ry").alias("rb")).where("ra <> rb").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The links (a, b) among (ra, rb). Texts of documents in no pair are left out by a bitmap of fixed size."""
        many = pairs.groupBy("ra").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
        salted = pairs.join(many, "ra").select("ra", "rb", F.pmod(F.xxhash64("rb"), "groups").alias("salt"))
        roles = salted.select("ra", "salt").distinct().select(F.col("ra").alias("id"), F.col("ra").alias("key"), "salt", F.lit(0).alias("role"))
        roles = roles.union(salted.select("rb", "ra", "salt", F.lit(1)))
        bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
        # at most FILTER_BITS / 64 rows
        wanted = roles.select(F.shiftrightunsigned(bit, 6).alias("w"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(id), {FILTER_BITS}) & 63 as int))").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
        texts = self.docs.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
        texts = texts.join(F.broadcast(wanted), F.shiftrightunsigned("h", 6) == F.col("w")).where(F.expr("(m & shiftleft(1L, cast(h & 63 as int))) <> 0")).select("doc_id", "text")
        rows = texts.join(roles, F.col("doc_id") == F.col("id")).select("key", "salt", "role", "doc_id", "text")
        n = partitions(self.spark)
        return rows.repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "role").mapInArrow(_verify(self.width, self.percent), "a long, b long")

    def across(self, lists: DataFrame, hubs: int | None) -> DataFrame:
        """Distinct pairs (x, y) of one list of mixed() and two components, but for those within the list's largest component.

        With hubs, only pairs with so many members of the largest component, those with most copies first.
        """
        left = lists.where("comp <> main").select("token", *(F.col(c).alias(f"{c}1") for c in ("node", "n", "pos", "comp")))
        right = lists
        if hubs:
            place = F.row_number().over(Window.partitionBy("token").orderBy(F.desc("copies"), "node"))
            right = right.where("comp = main").withColumn("place", place).where(F.col("place") <= hubs)
        right = right.select("token", "main", *(F.col(c).alias(f"{c}2") for c in ("node", "n", "pos", "comp")))
        room = F.least(F.col("n1") - F.col("pos1"), F.col("n2") - F.col("pos2"))
        apart = (F.col("comp1") != F.col("comp2")) & ((F.col("comp2") == F.col("main")) | (F.col("node1") < F.col("node2")))
        could = room * (100 + self.percent) >= (F.col("n1") + F.col("n2")) * self.percent
        fits = F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * self.percent
        rows = left.alias("l").join(right.alias("r"), (F.col("l.token") == F.col("r.token")) & apart & could & fits)
        return rows.select(F.least("node1", "node2").alias("x"), F.greatest("node1", "node2").alias("y")).distinct()

    def links(self) -> DataFrame:
        """Verified links (a, b) of class representatives that connect every component of the join.

        Rounds with HUBS members of each list's largest component settle most of it; the last round
        takes all pairs across components that are left.
        """
        keep = self.scratch.keep
        postings = self.postings()
        ids = self.sets.where("n > 0").join(self.classes.withColumnRenamed("node", "d1"), ["d1", "d2", "n"]).groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a <> b").select("a", "b")
        links, tried = keep(ids, "links-0"), None
        for k, hubs in enumerate([*HUBS, None], 1):
            comp = keep(components(self.spark, links, self.scratch, f"cc-{k}"), f"comp-{k}")
            # components only merge, so a list within one component stays so
            lists = self.mixed(postings, comp, k)
            postings = lists.select("token", "node", "n", "pos")
            pairs = self.candidates(self.across(lists, hubs))
            if tried is not None:
                pairs = pairs.join(tried, ["ra", "rb"], "left_anti")
            pairs = keep(pairs, f"tried-{k}")
            tried = pairs if tried is None else tried.union(pairs)
            links = links.union(keep(self.verified(pairs), f"links-{k}"))
        return links

    def documents(self) -> DataFrame:
        """(doc_id, unnamed, n, component) of every row; component is the id that stands for it, one with a name where there is one."""
        comp = components(self.spark, self.links(), self.scratch, "cc")
        label = self.classes.join(comp.withColumnRenamed("node", "r"), F.col("rep") == F.col("r"), "left").select(F.col("node").alias("d1"), "d2", "n", F.coalesce("comp", "rep").alias("c"))
        rows = self.sets.select("doc_id", "unnamed", "d1", "d2", "n").join(label, ["d1", "d2", "n"], "left").select("doc_id", "unnamed", "n", F.coalesce("c", "doc_id").alias("component"))
        if self.sets.where("unnamed").isEmpty():
            return rows
        named = rows.where("not unnamed").groupBy(F.col("component").alias("c")).agg(F.min("doc_id").alias("named"))
        return rows.join(named, F.col("component") == F.col("c"), "left").select("doc_id", "unnamed", "n", F.coalesce("named", "component").alias("component"), F.col("named").isNull().alias("nameless"))

    def members(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every document."""
        rows = self.documents()
        nameless = F.col("nameless") if "nameless" in rows.columns else F.lit(False)
        return rows.select(F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), F.when(~nameless, F.col("component")).alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: the component of every document."""
    return Join(table(spark, sf_dir, "documents")).members()


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component: that of its smallest doc_id, or, where its rows have none, any of them.

    Rows without words all stay. Rows that repeat a doc_id come down to one, with the smallest hash of
    text; ties between equal texts fall to the smallest columns, shown as JSON. All columns are kept,
    whatever their names.
    """
    join = Join(docs)
    found = join.documents().groupBy("doc_id").agg(F.min(F.when(F.col("n") > 0, F.col("component"))).alias("component"), F.count("*").alias("rows"))
    found = join.scratch.keep(found.where("component is not null and (component <> doc_id or rows > 1)"), "found")
    key = F.coalesce(F.col("row.doc_id").cast("long"), F.xxhash64("row.text"))
    named = docs.select(F.struct(*docs.columns).alias("row")).withColumn("key", key)
    one = named.join(found.select(F.col("doc_id").alias("key")), "key", "left_anti").select("row")
    repeated = found.where("rows > 1")
    if repeated.isEmpty():  # then no more is to be looked at, and the texts are dealt once
        return one.select("row.*")
    # the first rows of repeated ids, and rows without words that share an id with rows that have some
    wordy = F.coalesce(F.rlike(F.col("row.text"), F.lit(r"[^\x20\x09-\x0D]")), F.lit(False))
    again = named.join(repeated.select(F.col("doc_id").alias("key"), (F.col("component") == F.col("doc_id")).alias("stays")), "key")
    again = join.scratch.keep(again.withColumn("wordy", wordy).where("stays or not wordy"), "again")
    first = again.where("wordy").groupBy("key").agg(F.min_by("row", F.struct(F.xxhash64("row.text"), F.to_json("row"))).alias("row")).select("row")
    return one.union(first).union(again.where("not wordy").select("row")).select("row.*")
