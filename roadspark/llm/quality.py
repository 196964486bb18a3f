"""Quality by hierarchical empirical Bayes: document evidence shrunk toward path, host and global rates.

A logistic classifier over counts of the whole text, trained on a bounded sample of labelled rows,
gives each document's probability p. Grouped sums of p give host and path rates; each is a posterior
mean that shrinks its own sum toward the level above with a strength k, estimated from how much rates
differ between groups (method of moments). A document's own p is left out of its site's sums. The
result is logit(p) + logit(path rate) - logit(global rate). documents has no URL, so its source stands
for the host and its lang for the path.

Edge cases: null or empty text has the features of no words; a null host or path is a group of its
own; without labels of both kinds every p is the share of good labels (or 0.5); rows that repeat a
doc_id are scored row by row (a repeated label counts once, the smallest); rows with equal text and
site tie; long texts are read whole, in bounded passes; an empty table gives no rows. ``accepted`` keeps
all columns as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _kernel as K
from ._spark import Scratch, bounded_batches, table

#: About so many labelled documents train the classifier.
SAMPLE = 20_000
THRESHOLD = 0.5
LOW, HIGH = 1.0, 1000.0
#: Classes of bytes: letters, capitals, digits, sentence marks, other marks, line ends, bytes above ASCII.
CLASSES = np.zeros((256, 7))
for _k, _bytes in enumerate([[*range(65, 91), *range(97, 123)], range(65, 91), range(48, 58), b".,;:'\"?()-", b"!#$%&*+/<=>@[\\]^_`{|}~", b"\n", range(128, 256)]):
    CLASSES[list(_bytes), _k] = 1
N_FEATURES = 16


def features(column) -> np.ndarray:
    """[rows, N_FEATURES] of an Arrow string array."""
    out = []
    for i, j, data, offsets in K.chunks(column):
        sums = np.zeros((j - i, CLASSES.shape[1]))
        size = np.diff(offsets)
        for k in range(CLASSES.shape[1]):
            run = np.concatenate([[0], np.cumsum(CLASSES[:, k][data])])
            sums[:, k] = run[offsets[1:]] - run[offsets[:-1]]
        start, end, bounds = K.words(data, offsets)
        hashes = K.span_hashes(K.LOWER[data], start, end)
        again = np.concatenate([[0], np.cumsum(np.concatenate([[False], hashes[1:] == hashes[:-1]]))]) if len(hashes) else np.zeros(1)
        short = np.concatenate([[0], np.cumsum(end - start <= 2)])
        n = np.diff(bounds)
        few = np.maximum(1, n)
        rows = np.zeros((j - i, N_FEATURES))
        rows[:, :7] = sums / np.maximum(1, size)[:, None]
        rows[:, 1] = sums[:, 1] / np.maximum(1, sums[:, 0])
        rows[:, 7] = np.log1p(n)
        rows[:, 8] = (np.add.reduceat(np.append(end - start, 0), np.minimum(bounds[:-1], len(start)))[: j - i] if len(start) else 0) * (n > 0) / few
        rows[:, 9] = (again[bounds[1:]] - again[np.minimum(bounds[:-1] + 1, bounds[1:])]) / few if len(hashes) else 0
        rows[:, 10] = (short[bounds[1:]] - short[bounds[:-1]]) / few
        for k in range(j - i):
            own = hashes[bounds[k] : bounds[k + 1]]
            if len(own):
                _, counts = np.unique(own, return_counts=True)
                rows[k, 11], rows[k, 12] = counts.max() / len(own), len(counts) / len(own)
                rows[k, 13] = len(counts) / np.sqrt(len(own))
        rows[:, 14] = rows[:, 4] ** 0.5
        rows[:, 15] = rows[:, 1] * (n > 3)
        out.append(rows)
    return np.concatenate(out) if out else np.zeros((0, N_FEATURES))


class Classifier:
    """Logistic regression on standardised features, fitted by damped Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        self.rate = float(y.mean()) if len(y) else 0.5
        self.center = self.scale = self.weights = None
        if not len(y) or not 0 < self.rate < 1:
            return
        self.center, self.scale = x.mean(0), x.std(0) + 1e-9
        z = self._design(x)
        w = np.zeros(z.shape[1])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.eye(len(w)), z.T @ (y - p) - w)
            w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        self.weights = w

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.center) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), z, z * z])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.rate)
        return np.clip(1 / (1 + np.exp(-np.clip(self._design(x) @ self.weights, -30, 30))), 1e-4, 1 - 1e-4)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fits the classifier on about ``sample`` labelled documents, chosen by a hash of doc_id."""
    bounded_batches(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("quality").alias("quality"))
    n = known.count()
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 60))
    # about ``sample`` rows, so the join broadcasts them and no text is shuffled
    known = known.where(place < int(min(1.0, sample / max(1, n)) * (1 << 60)))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id")).select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["quality"].cast(pa.float64()), pa.array(list(features(batch["text"])), pa.list_(pa.float64()))], names=["y", "x"])

    found = rows.mapInArrow(run, "y double, x array<double>").toPandas()
    found = found.iloc[np.lexsort((*np.array(found["x"].tolist()).reshape(len(found), -1).T, found["y"]))] if len(found) else found
    return Classifier(np.array(found["x"].tolist()).reshape(-1, N_FEATURES), (found["y"].to_numpy(float) > 0).astype(float))


def evidence(docs: DataFrame, model: Classifier, row: str | None = None) -> DataFrame:
    """docs with p (replacing a column of that name), from their text or that of the struct ``row``."""
    docs = docs.drop("p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch[row].field("text") if row else batch["text"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model(features(text)), pa.float64())], names=[*batch.schema.names, "p"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields]).add("p", "double"))


def _strength(groups: DataFrame, total: str, n: str, above: Column) -> float:
    """k of a level: rate * (1 - rate) over the variance between its groups beyond what sampling gives, less 1."""
    seen = groups.where(f"{n} >= 2").select((F.col(total) / F.col(n)).alias("r"), above.alias("a"), F.col(n).alias("n"))
    spread, noise, inner = seen.agg(F.avg((F.col("r") - F.col("a")) ** 2), F.avg(F.col("a") * (1 - F.col("a")) / F.col("n")), F.avg(F.col("a") * (1 - F.col("a")))).first()
    if spread is None:
        return HIGH
    between = spread - noise
    return HIGH if between <= 0 else float(min(HIGH, max(LOW, inner / between - 1)))


def sites(scored: DataFrame, scratch: Scratch) -> tuple[DataFrame, float, float, float]:
    """(host, path) sums of p with those of the host, the global rate, and both strengths."""
    paths = scratch.keep(scored.groupBy("host", "path").agg(F.sum("p").alias("path_sum"), F.count("*").alias("path_n")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("path_sum").alias("host_sum"), F.sum("path_n").alias("host_n"))
    rate = hosts.agg(F.sum("host_sum") / F.sum("host_n")).first()[0] or 0.5
    k_host = _strength(hosts, "host_sum", "host_n", F.lit(rate))
    both = paths.alias("p").join(hosts.alias("h"), F.col("p.host").eqNullSafe(F.col("h.host"))).select("p.host", "path", "path_sum", "path_n", "host_sum", "host_n")
    k_path = _strength(both, "path_sum", "path_n", (F.col("host_sum") + k_host * rate) / (F.col("host_n") + k_host))
    return scratch.keep(both, "sites"), rate, k_host, k_path


def combined(scored: DataFrame, found: tuple[DataFrame, float, float, float]) -> DataFrame:
    """Adds host_rate, path_rate and quality to rows with host, path and p."""
    groups, rate, k_host, k_path = found
    groups = groups.select(F.col("host").alias("_h"), F.col("path").alias("_p"), "path_sum", "path_n", "host_sum", "host_n")
    rows = scored.join(groups, F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p")))
    host = (F.col("host_sum") - F.col("p") + k_host * rate) / (F.col("host_n") - 1 + k_host)
    rows = rows.withColumn("host_rate", host)
    rows = rows.withColumn("path_rate", (F.col("path_sum") - F.col("p") + k_path * F.col("host_rate")) / (F.col("path_n") - 1 + k_path))

    def logit(x: Column) -> Column:
        x = F.least(F.greatest(x, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(x / (1 - x))

    odds = logit(F.col("p")) + logit(F.col("path_rate")) - logit(F.lit(rate))
    return rows.withColumn("quality", 1 / (1 + F.exp(-odds))).drop("_h", "_p", "path_sum", "path_n", "host_sum", "host_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: doc_id, p, host_rate, path_rate, quality and keep of all documents."""
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark, "quality")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = evidence(docs.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), "text"), model).drop("text")
    scored = scratch.keep(scored, "scored")
    return combined(scored, sites(scored, scratch)).select("doc_id", "host", "path", "p", "host_rate", "path_rate", "quality", (F.col("quality") >= THRESHOLD).alias("keep"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose quality reaches THRESHOLD. Sites are summed in one pass, documents kept in a second; no text is shuffled while the sites fit a broadcast."""
    scratch = Scratch(docs.sparkSession, "quality")
    model = train(docs, labels)
    scored = evidence(docs.select(F.col("source").alias("host"), F.col("lang").alias("path"), "text"), model).drop("text")
    found = sites(scored, scratch)
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("source").alias("host"), F.col("lang").alias("path"))
    return combined(evidence(rows, model, "row"), found).where(F.col("quality") >= THRESHOLD).select("row.*")
