"""Readers and writers of the engine's tables and files. Every path may be a glob."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.functions import geo, roads

from . import codec

#: Schemas of the stage files.
NODES, EDGES, WEIGHTED = "id long, x double, y double", "u long, v long, weight long", "u long, v long, weight double"
BRIDGES, BOUNDARY = "u long, v long, weight long, shard_u long, shard_v long", "node_id long"
KINDS = {"nodes": NODES, "edges": EDGES, "boundary_in": BOUNDARY, "boundary_out": BOUNDARY}
#: Records of a graph file that one row of bytes holds.
RECORDS = 20_000


def read_nodes(spark: SparkSession, pattern: str) -> DataFrame:
    """(id, x, y); columns beyond these are not read."""
    return spark.read.schema(NODES).parquet(pattern)


def read_edges(spark: SparkSession, pattern: str, whole: bool = True) -> DataFrame:
    """(u, v, weight), weights as stored: whole numbers or doubles."""
    return spark.read.schema(EDGES if whole else WEIGHTED).parquet(pattern)


def read_bridges(spark: SparkSession, pattern: str) -> DataFrame:
    """(u, v, weight, shard_u, shard_v)."""
    return spark.read.schema(BRIDGES).parquet(pattern)


def normalised(rows: DataFrame, schema: str) -> DataFrame:
    """The schema's columns, cast to its types; others are left out."""
    return rows.select(*(F.col(c).cast(t).alias(c) for c, t in (f.split() for f in schema.split(", "))))


def write_flat(rows: DataFrame, path: str, schema: str | None = None) -> None:
    """One parquet table."""
    (normalised(rows, schema) if schema else rows).write.mode("overwrite").parquet(path)


def write_by_shard(rows: DataFrame, path: str, kind: str) -> None:
    """A folder for each shard (unsigned id): path/kind/shard_id=.../part; the column lives in the path only.

    Rows are dealt by shard and a hash, so a large shard has several files and small ones few.
    """
    out = normalised(rows, f"{KINDS[kind]}, shard_id long").withColumn("shard_id", geo.unsigned(F.col("shard_id")))
    deal = F.pmod(F.xxhash64(*out.columns), F.lit(4))
    out.withColumn("_deal", deal).repartition("shard_id", "_deal").drop("_deal").write.mode("overwrite").partitionBy("shard_id").parquet(f"{path}/{kind}")


def signed(text: Column) -> Column:
    """The LONG with the bits of an unsigned decimal."""
    number = text.cast("decimal(21,0)")
    return F.when(number >= F.lit(str(1 << 63)).cast("decimal(21,0)"), number - F.lit(str(1 << 64)).cast("decimal(21,0)")).otherwise(number).cast("long")


def read_by_shard(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(shard_id, columns of the kind), the shard from the path; a filter on it reads only its folders."""
    rows = spark.read.schema(f"{KINDS[kind]}, shard_id string").parquet(f"{path}/{kind}")
    return rows.withColumn("shard_id", signed(F.col("shard_id")))


def read_nested(spark: SparkSession, pattern: str, kind: str) -> DataFrame:
    """As read_by_shard, for the layout shard_id=.../kind/part; an error for paths without a shard."""
    rows = spark.read.schema(KINDS[kind]).parquet(f"{pattern}/{kind}")
    return rows.withColumn("shard_id", signed(roads.shard_of_path(F.input_file_name())))


def shard_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables of all shards; a shard's own rows are those of a filter on shard_id."""
    return {kind: read_by_shard(spark, path, kind) for kind in KINDS}


def shard_paths(spark: SparkSession, pattern: str) -> DataFrame:
    """(shard_id, path) of every file that matches; no content is read."""
    files = spark.read.format("binaryFile").load(pattern).select("path")
    return files.select(signed(roads.shard_of_path(F.col("path"))).alias("shard_id"), "path")


def read_bytes(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, content)."""
    return spark.read.format("binaryFile").load(pattern).select("path", "content")


def write_bytes(rows: DataFrame, base: str) -> DataFrame:
    """One file base/name for each name of rows (name, part, content), its parts in a row; returns (name, bytes) once written.

    A file is written under another name and then renamed, so a task that runs twice leaves one whole
    file. Parts are streamed; no file is held in memory. ``base`` is a path or URI that executors reach.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs
        from pyspark import TaskContext

        scheme = re.match(r"[a-zA-Z][\w+.-]*:", base)
        store, root = fs.FileSystem.from_uri(base if scheme else f"file://{base}")
        name, out, size, own = None, None, 0, f".{TaskContext.get().taskAttemptId()}.part"

        def done() -> pd.DataFrame:
            out.close()
            store.move(posixpath.join(root, f"{name}{own}"), posixpath.join(root, name))
            return pd.DataFrame({"name": [name], "bytes": [size]})

        for part in parts:
            for n, content in zip(part["name"], part["content"], strict=True):
                if n != name:
                    if out is not None:
                        yield done()
                    name, size = n, 0
                    store.create_dir(posixpath.dirname(posixpath.join(root, n)), recursive=True)
                    out = store.open_output_stream(posixpath.join(root, f"{n}{own}"))
                out.write(bytes(content))
                size += len(content)
        if out is not None:
            yield done()

    named = rows.where("name is not null and content is not null").select("name", "part", "content")
    return named.repartition("name").sortWithinPartitions("name", "part").mapInPandas(run, "name string, bytes long")


RECORD = "kind string, u long, v long, weight long, x double, y double"


def shard_records(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(shard_id, kind, u, v, weight, x, y): everything a shard's graph file holds."""
    from roadspark.operators import graph

    none = [F.lit(None).cast(t) for t in ("long", "long", "double", "double")]
    inner = edges.where("shard_u = shard_v").select(F.col("shard_u").alias("shard_id"), F.lit("edge").alias("kind"), "u", "v", roads.stored_weight(F.col("weight")).alias("weight"), *(c.alias(n) for c, n in zip(none[2:], "xy", strict=True)))
    out = inner.union(nodes.select("shard_id", F.lit("node"), "id", none[0], none[1], "x", "y"))
    for kind, found in (("in", graph.boundary_in(edges)), ("out", graph.boundary_out(edges))):
        out = out.union(found.select("shard_id", F.lit(kind), "node_id", *none))
    return out


def overlay_records(edges: DataFrame, found: DataFrame, locations: DataFrame) -> DataFrame:
    """(kind, u, v, weight, x, y): bridges, shortcuts and the places of boundary nodes."""
    none = [F.lit(None).cast(t) for t in ("long", "long", "double", "double")]
    out = edges.where("shard_u <> shard_v").select(F.lit("bridge").alias("kind"), "u", "v", roads.stored_weight(F.col("weight")).alias("weight"), *(c.alias(n) for c, n in zip(none[2:], "xy", strict=True)))
    out = out.union(found.select(F.lit("shortcut"), "src", "dst", "weight", *none[2:]))
    return out.union(locations.select(F.lit("node"), "node_id", none[0], none[1], "x", "y"))


def encoded(records: DataFrame, shard: bool) -> DataFrame:
    """(name, part, content): graph files in parts of at most RECORDS records, sorted by kind and ids within a part."""
    name = F.concat(F.lit("shard_id="), geo.unsigned(F.col("shard_id")), F.lit("/graph.pb")) if shard else F.lit("overlay_graph.pb")
    many = F.ceil(F.count("*") / RECORDS).cast("long")
    named = records.withColumn("name", name)
    sizes = named.groupBy("name").agg(many.alias("parts"))
    dealt = named.join(sizes, "name").withColumn("part", F.pmod(F.xxhash64("kind", "u", "v", "weight"), F.greatest("parts", F.lit(1))))

    def run(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for some in rows:
            for n, p, kind, u, v, w, x, y in some[["name", "part", "kind", "u", "v", "weight", "x", "y"]].itertuples(index=False, name=None):
                if (n, p) != key:
                    if key:
                        yield pd.DataFrame({"name": [key[0]], "part": [key[1]], "content": [b"".join(held)]})
                    key, held = (n, p), []
                held.append(codec.encoded(kind, shard, int(u), None if pd.isna(v) else int(v), None if pd.isna(w) else int(w), x, y))
        if key:
            yield pd.DataFrame({"name": [key[0]], "part": [key[1]], "content": [b"".join(held)]})

    return dealt.repartition("name", "part").sortWithinPartitions("name", "part", "kind", "u", "v").mapInPandas(run, "name string, part long, content binary")


def decoded(files: DataFrame, shard: bool) -> DataFrame:
    """(path, kind, u, v, weight, x, y) of graph files (path, content)."""
    read = codec.shard_rows if shard else codec.overlay_rows

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "u", "v", "weight", "x", "y"]
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows = pd.DataFrame(list(read(bytes(content))), columns=columns).astype({"u": "Int64", "v": "Int64", "weight": "Int64"})
                rows.insert(0, "path", path)
                yield rows

    return files.select("path", "content").mapInPandas(run, f"path string, {RECORD}")


CASES = "name string, category string, start_lat double, start_lng double, end_lat double, end_lng double, description string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a YAML file with a list test_cases of name, category, start, end and, at will, description."""
    import yaml  # only this reader needs it

    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    found = (yaml.safe_load(text) or {}).get("test_cases") or []
    rows = [(c["name"], c["category"], float(c["start"]["lat"]), float(c["start"]["lng"]), float(c["end"]["lat"]), float(c["end"]["lng"]), c.get("description", "")) for c in found]
    return spark.createDataFrame(rows, CASES)


def of_category(cases: DataFrame, category: str | None = None, name: str | None = None) -> DataFrame:
    """The cases of a category, or with a name."""
    rows = cases.where(F.col("category") == category) if category else cases
    return rows.where(F.col("name") == name) if name else rows


def write_tsv(rows: DataFrame, path: str, notes: list[str], order: list[str]) -> None:
    """Tab-separated text in one sorted file: note lines that begin with #, a # line, the head, the rows.

    For reports, which are small; long timelines are sorted over many files that follow each other in
    name order, the first of them with the head.
    """
    shown = F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns))
    head = [*(f"# {n}" for n in notes), "#", "\t".join(rows.columns)]
    first = rows.sparkSession.createDataFrame([("\n".join(head),)], "value string")
    body = rows.orderBy(*order).select(shown.alias("value"))
    first.coalesce(1).union(body).write.mode("overwrite").text(path)
