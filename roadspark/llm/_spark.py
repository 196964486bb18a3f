"""Spark helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F


#: Rows of an Arrow batch: texts are long, and Python workers hold a batch or two.
BATCH = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH:
        spark.conf.set(key, str(BATCH))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark runs on this machine alone, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


class Scratch:
    """Tables written to the shared folder; they cut lineage, and any executor can read them again.

    A result may still read its operator's tables, so they stay until ``clear``, or ``released``.
    """

    opened: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str) -> None:
        bounded_batches(spark)
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Scratch.opened.append(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self._delete(f"{self.root}/{name}")

    def clear(self) -> None:
        self._delete(self.root)

    def _delete(self, where: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Deletes, at its end, the tables of all Scratch objects made within: for results that are written by then."""
    before = len(Scratch.opened)
    yield
    for scratch in Scratch.opened[before:]:
        scratch.clear()
    del Scratch.opened[before:]


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(spark: SparkSession, edges: DataFrame, scratch: Scratch, tag: str) -> DataFrame:
    """Connected components of the edges (a, b): rows (node, comp), comp the smallest node of each.

    Alternates large-star and small-star contraction, every round written to the shared folder,
    until a round changes nothing; nothing but three numbers a round reaches the driver.
    """
    def canonical(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(df: DataFrame, large: bool) -> DataFrame:
        both = df.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.union(df.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")) if large else both.groupBy("u").agg(F.min("v").alias("m"))
        joined = both.join(least, "u")
        if large:
            return canonical(joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        return canonical(joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = scratch.keep(canonical(edges), f"{tag}-0")
    before, k = state(now), 0
    while before[0]:
        k += 1
        now = scratch.keep(star(star(now, True), False), f"{tag}-{k}")
        after = state(now)
        scratch.drop(f"{tag}-{k - 1}")
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def running_sum(df: DataFrame, order: list, value, name: str, scratch: Scratch, tag: str) -> DataFrame:
    """Adds the sum of value over all rows before each in the global order, without a single-task sort.

    Rows are dealt by range and written; the sums of the ranges (one row each) give every range its base.
    """
    parts = scratch.keep(df.withColumn("_v", value).repartitionByRange(partitions(df.sparkSession), *order).withColumn("_pid", F.spark_partition_id()), tag)
    base = parts.groupBy("_pid").agg(F.sum("_v").alias("_s"))
    base = base.select("_pid", (F.sum("_s").over(Window.orderBy("_pid")) - F.col("_s")).alias("_base"))
    within = F.sum("_v").over(Window.partitionBy("_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    # base has one row for each range: its size is bounded by the number of partitions
    return parts.join(F.broadcast(base), "_pid").withColumn(name, F.coalesce(within, F.lit(0)) + F.col("_base")).drop("_v", "_pid", "_base")


def range_of(key: Column, bounds: list[int], lo: int = 0) -> Column:
    """How many bounds are <= key, as a binary search."""
    if not bounds:
        return F.lit(lo)
    mid = len(bounds) // 2
    return F.when(key < bounds[mid], range_of(key, bounds[:mid], lo)).otherwise(range_of(key, bounds[mid + 1 :], lo + mid + 1))
