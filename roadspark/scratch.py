"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Seconds of a write after which its shuffle files are asked back.
LONG_S = 2


class Keeper:
    """keep(df, name) writes a table below spark.checkpoint.dir and reads it again; this cuts lineage.

    Spark deletes a finished write's shuffle files when the driver's collector finds its plan unused,
    which in a large heap may be never; so it is asked to look after every longer write. Where that setting is unset, a temporary folder serves, but only if Spark runs on this machine alone.
    """

    def __init__(self, spark: SparkSession) -> None:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            root = tempfile.mkdtemp(prefix="roads-")
        self.spark, self.root = spark, f"{root}/roads-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        began = time.monotonic()
        df.write.option("compression", "zstd").parquet(self.path(name))
        if time.monotonic() - began > LONG_S:
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
