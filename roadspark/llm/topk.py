"""Exact top-k search by inner product, block at a time.

Vectors are cut by ranges of vec_id into blocks, and runs of blocks into groups. A block's forward index
is its integer matrix; summaries hold every term's maximum and minimum, of blocks and of groups. The
bound of a query over a block or group is the sum of its terms' best products. The search has three
steps, and no vector is shuffled to a group that its bounds rule out:

1. queries meet the groups' summaries (cells of SUMMARIES groups and QUERIES queries), which gives every
   query the group with the highest bound; scoring that group gives its first k-th best score;
2. queries meet the summaries again: groups whose bound falls below that score are dropped;
3. the pairs that are left meet the groups' blocks: a query's blocks are taken by descending bound and
   scored until the bound falls below its k-th best score so far.

Ties fall to the smaller vec_id, so a block or group whose bound equals the k-th score is still scored.

Edge cases: vectors that are null, or hold a null or non-finite component, take no part; nor do null
vec_ids; vectors of other lengths than the query's are no candidates of it; rows that repeat a vec_id
are rows of their own, and none of them is a candidate of a query with that id; fewer than k
candidates give fewer rows; an empty table gives no rows; columns other than vec_id and embedding only
serve to choose queries. Sums that could pass 2**53 are taken in exact integers; scores beyond the range
of LONG are cut to it, and tie there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch, partitions, table

TOP, EVERY, SCALE = 5, 50, 256
#: Vectors of a block (fewer where BYTES of them are reached), blocks of a group, groups and queries of a cell, queries that meet one copy of a group.
BLOCK, BYTES, GROUP, SUMMARIES, QUERIES, PER_COPY = 128, 1 << 16, 64, 1024, 100_000, 10_000
FLOOR, CEILING = -(1 << 63), (1 << 63) - 1


def integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, dim, x array<long>) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(whole)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.size("embedding").alias("dim"), F.transform(x, lambda v: F.floor(v * SCALE).cast("long")).alias("x"))


BLOCKS = "kind int, dim int, grp long, place int, ids binary, rows binary"


def _blocks(size: int, group: int):
    """Kind 0: a block, its place in its group; kind 1: a group's maxima (ids) and minima (rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, dim, done = [], [], None, 0
        high = low = None
        first = TaskContext.get().partitionId() << 32

        def row(kind: int, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            values = [kind, dim, first + done // group, done % group, a.tobytes(), b.tobytes()]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["kind", "dim", "grp", "place", "ids", "rows"])

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal done, high, low
            m = np.array(rows, np.int64)
            high = m.max(0) if high is None else np.maximum(high, m.max(0))
            low = m.min(0) if low is None else np.minimum(low, m.min(0))
            yield row(0, np.array(ids, np.int64), m)
            if last or done % group == group - 1:
                yield row(1, high, low)
                high = low = None
                done = (done // group + 1) * group
            else:
                done += 1
            ids.clear()
            rows.clear()

        for batch in batches:
            for i, d, x in zip(*(batch[c].to_pylist() for c in ("vec_id", "dim", "x")), strict=True):
                if ids and (d != dim or len(ids) >= max(16, min(size, BYTES // (8 * max(1, d))))):
                    yield from flush(d != dim)
                dim = d
                ids.append(i)
                rows.append(x)
        if ids:
            yield from flush(True)

    return run


def blocked(whole: DataFrame, size: int = BLOCK, group: int = GROUP) -> DataFrame:
    """The blocks and group summaries of integers(), by ranges of (dim, vec_id); groups are numbered within their range."""
    n = partitions(whole.sparkSession)
    return whole.repartitionByRange(n, "dim", "vec_id").sortWithinPartitions("dim", "vec_id").mapInArrow(_blocks(size, group), BLOCKS)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in exact integers, cut to the range of LONG."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    if float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max()) * a.shape[1] < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, FLOOR, CEILING).astype(np.int64)


def _bounds(q: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The highest score that each query can have with a vector between low and high."""
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    top = float(np.abs(q.astype(float)).max(initial=0)) * float(max(np.abs(high.astype(float)).max(initial=0), np.abs(low.astype(float)).max(initial=0))) * q.shape[1]
    if top < 2**52:
        return _product(up, high) + _product(down, low)
    return np.clip(up.astype(object) @ high.astype(object).T + down.astype(object) @ low.astype(object).T, FLOOR, CEILING).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.lexsort((ids, ~scores))[:k]  # ~x falls as x rises, without overflow
    return ids[by], scores[by]


def search(blocks: list[tuple[np.ndarray, np.ndarray]], queries: tuple[np.ndarray, np.ndarray, list], k: int) -> Iterator[tuple[int, int, int]]:
    """(query's place, vec_id, score): for each query its k best in these blocks, but for those below its start."""
    qids, q, starts = queries
    high, low = np.array([m.max(0) for _, m in blocks]), np.array([m.min(0) for _, m in blocks])
    bounds = _bounds(q, high, low)
    order = np.argsort(~bounds, axis=1, kind="stable")
    held = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(qids)
    kth = list(starts)
    live = np.arange(len(qids))
    for turn in range(len(blocks)):
        live = np.array([i for i in live if kth[i] is None or bounds[i, order[i, turn]] >= kth[i]], np.int64)
        if not len(live):
            break
        chosen = order[live, turn]
        for b in np.unique(chosen):
            ids, m = blocks[b]
            asked = live[chosen == b]
            scores = _product(q[asked], m)
            for i, own in zip(asked.tolist(), scores, strict=True):
                fits = ids != qids[i]
                if kth[i] is not None:
                    fits &= own >= kth[i]
                if not fits.any():
                    continue
                some, best = ids[fits], own[fits]
                if len(best) > 4 * k:  # only what may reach the k-th place is sorted
                    least = np.partition(best, len(best) - k)[len(best) - k]
                    some, best = some[best >= least], best[best >= least]
                held[i] = _best(np.concatenate([held[i][0], some]), np.concatenate([held[i][1], best]), k)
                if len(held[i][1]) == k:
                    kth[i] = max(int(held[i][1][-1]), kth[i] if kth[i] is not None else FLOOR)
    for i, (ids, scores) in enumerate(held):
        for v, s in zip(ids.tolist(), scores.tolist(), strict=True):
            yield i, v, s


def _rows(out: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * len(names))], names=names)


def _by_key(batches: Iterator[pa.RecordBatch], key: list[str], start, step) -> Iterator[list[tuple]]:
    """Rows sorted by key and role: start(row) takes those of role 0, step(rows) those of role 1, some at a time."""
    here = None
    for batch in batches:
        out, asked = [], []
        for r in batch.to_pylist():
            now = tuple(r[c] for c in key)
            if now != here or (asked and not r["role"]):
                if asked:
                    out += step(asked)
                    asked = []
                if now != here:
                    here = now
                    start(None)
            if r["role"]:
                asked.append(r)
            else:
                start(r)
        if asked:
            out += step(asked)
        yield out


def _matrix(rows: list[dict], column: str) -> np.ndarray:
    return np.array([np.frombuffer(r[column], np.int64) for r in rows])


def _judge(first: bool):
    """Queries meet the summaries of a cell: the group with the highest bound, or all that reach the k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: list[dict] = []

        def start(r: dict | None) -> None:
            groups.append(r) if r else groups.clear()

        def step(asked: list[dict]) -> list[tuple]:
            if not groups:
                return []
            numbers = np.array([g["grp"] for g in groups])
            bounds = _bounds(_matrix(asked, "ids"), _matrix(groups, "ids"), _matrix(groups, "rows"))
            at = np.array([r["at"] for r in asked])
            if first:
                best = bounds.argmax(1)
                return list(zip(at.tolist(), numbers[best].tolist(), bounds[np.arange(len(at)), best].tolist(), strict=True))
            least = np.array([FLOOR if r["kth"] is None else r["kth"] for r in asked])
            i, j = np.nonzero((bounds >= least[:, None]) & (numbers != np.array([r["grp"] for r in asked])[:, None]))
            return list(zip(at[i].tolist(), numbers[j].tolist(), bounds[i, j].tolist(), strict=True))

        for out in _by_key(batches, ["dim", "cell", "part"], start, step):
            yield _rows(out, ["at", "grp", "bound"])

    return run


def _meet(k: int):
    """Queries meet the blocks of a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: list[tuple[np.ndarray, np.ndarray]] = []

        def start(r: dict | None) -> None:
            if r is None:
                blocks.clear()
            else:
                blocks.append((np.frombuffer(r["ids"], np.int64), np.frombuffer(r["rows"], np.int64).reshape(-1, r["dim"])))

        def step(asked: list[dict]) -> list[tuple]:
            if not blocks:
                return []
            ids = np.array([r["query_id"] for r in asked], np.int64)
            found = search(blocks, (ids, _matrix(asked, "ids"), [r["kth"] for r in asked]), k)
            return [(asked[i]["at"], int(ids[i]), v, s) for i, v, s in found]

        for out in _by_key(batches, ["dim", "grp", "part"], start, step):
            yield _rows(out, ["at", "query_id", "vec_id", "score"])

    return run


class Search:
    """The search of one table: blocks, summaries, queries, and the three steps."""

    def __init__(self, vectors: DataFrame, chosen, k: int = TOP, block: int = BLOCK, group: int = GROUP) -> None:
        self.spark, self.k = vectors.sparkSession, k
        self.scratch = Scratch(self.spark, "topk")
        keep = self.scratch.keep
        found = keep(blocked(integers(vectors), block, group), "blocks")
        self.blocks, self.groups = found.where("kind = 0"), found.where("kind = 1")
        asked = integers(vectors.where(chosen)).withColumn("at", F.monotonically_increasing_id())
        self.queries = keep(asked.mapInArrow(_packed, "dim int, at long, query_id long, ids binary"), "queries")

    def cells(self, extra: DataFrame) -> DataFrame:
        """Queries (dim, at, query_id, ids, kth, grp) and group summaries, dealt to cells."""
        n = partitions(self.spark)
        # one row for each dimension
        sizes = self.groups.groupBy("dim").agg(F.ceil(F.count("*") / SUMMARIES).cast("int").alias("cells"))
        sizes = sizes.join(self.queries.groupBy("dim").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("parts")), "dim")
        known = self.groups.join(F.broadcast(sizes), "dim").select("dim", F.pmod(F.xxhash64("grp"), "cells").cast("int").alias("cell"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("role"), "grp", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("kth"), "ids", "rows")
        asked = extra.join(F.broadcast(sizes), "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), F.pmod(F.xxhash64("at"), "parts").cast("int").alias("part"), F.lit(1).alias("role"), "grp", "at", "kth", "ids", F.lit(None).cast("binary").alias("rows"))
        return known.union(asked).repartition(n, "dim", "cell", "part").sortWithinPartitions("dim", "cell", "part", "role")

    def scored(self, pairs: DataFrame, tag: str) -> DataFrame:
        """(at, query_id, vec_id, score) of pairs (dim, grp, at, query_id, ids, kth): only their groups' blocks are dealt, and a group that many ask for in copies."""
        n = partitions(self.spark)
        wanted = self.scratch.keep(pairs.groupBy("dim", "grp").agg(F.ceil(F.count("*") / PER_COPY).cast("int").alias("copies")), f"wanted-{tag}")
        blocks = self.blocks.join(wanted, ["dim", "grp"]).select("dim", "grp", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("part"), F.lit(0).alias("role"), "place", F.lit(None).cast("long").alias("at"), F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("long").alias("kth"), "ids", "rows")
        # at most a row for each PER_COPY pairs; so a group that many ask for is never one key
        hot = wanted.where("copies > 1")
        copies = F.coalesce("copies", F.lit(1))
        asked = pairs.join(F.broadcast(hot), ["dim", "grp"], "left").select("dim", "grp", F.pmod(F.xxhash64("at"), copies).cast("int").alias("part"), F.lit(1).alias("role"), F.lit(0).alias("place"), "at", "query_id", "kth", "ids", F.lit(None).cast("binary").alias("rows"))
        dealt = blocks.union(asked).repartition(n, "dim", "grp", "part").sortWithinPartitions("dim", "grp", "part", "role", "place")
        return dealt.mapInArrow(_meet(self.k), "at long, query_id long, vec_id long, score long")

    def run(self) -> DataFrame:
        """(query_id, rank, vec_id, score)."""
        keep, none = self.scratch.keep, F.lit(None).cast("long")
        judged = self.cells(self.queries.withColumn("kth", none).withColumn("grp", none)).mapInArrow(_judge(True), "at long, grp long, bound long")
        start = keep(judged.groupBy("at").agg(F.max_by("grp", F.struct("bound", "grp")).alias("grp")).join(self.queries, "at"), "start")
        first = keep(self.scored(start.withColumn("kth", none), "first"), "first")
        kth = first.groupBy("at").agg(F.min("score").alias("kth"), F.count("*").alias("n")).select("at", F.when(F.col("n") >= self.k, F.col("kth")).alias("kth"))
        asked = keep(start.join(kth, "at", "left"), "asked")
        pairs = self.cells(asked).mapInArrow(_judge(False), "at long, grp long, bound long").select("at", "grp")
        self.pairs = keep(pairs, "pairs")
        more = self.scored(keep(self.pairs.join(asked.drop("grp"), "at"), "asking"), "more")
        hits = first.union(more)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return hits.withColumn("rank", place).where(F.col("rank") <= self.k).select("query_id", "rank", "vec_id", "score")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [np.array(x, np.int64).tobytes() for x in batch["x"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["dim"], batch["at"], batch["vec_id"], pa.array(vectors, pa.binary())], names=["dim", "at", "query_id", "ids"])


def top_k(vectors: DataFrame, chosen, k: int = TOP, block: int = BLOCK, group: int = GROUP) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of vectors (vec_id, embedding) where chosen holds."""
    return Search(vectors, chosen, k, block, group).run()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: the 5 best of every vector whose vec_id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % EVERY == 0)


SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
p AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % {EVERY} = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {TOP}
"""
