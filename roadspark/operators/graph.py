"""Ways to directed edges, shards, bridges and boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadspark.functions import geo, roads

TAGS = ("highway", "maxspeed", "maxspeed_forward", "maxspeed_backward", "surface", "tracktype", "service")


def tag_columns(tags: str = "tags") -> list[Column]:
    """The seven tags of a map, as columns."""
    return [F.col(tags)[t.replace("maxspeed_", "maxspeed:")].alias(t) for t in TAGS]


def project_tags(ways: DataFrame) -> DataFrame:
    """(way_id, node_refs, oneway, the seven tags) of ways with a tags map."""
    return ways.select("way_id", "node_refs", F.col("tags")["oneway"].alias("oneway"), *tag_columns())


def way_edges(ways: DataFrame, keep: tuple[str, ...] = TAGS, only_driveable: bool = True) -> DataFrame:
    """Directed edges (way_id, seq, u, v, direction, tags) of consecutive nodes; -1 means against the way's order."""
    if only_driveable:
        ways = ways.where(roads.driveable(F.col("highway")))
    pairs = F.transform(F.sequence(F.lit(0), F.size("node_refs") - 2), lambda i: F.struct(F.get("node_refs", i).alias("a"), F.get("node_refs", i + 1).alias("b")))
    rows = ways.where(F.size("node_refs") >= 2).select("way_id", "oneway", *keep, F.posexplode(pairs).alias("seq", "p"))
    side = F.lower("oneway")
    forward = F.struct(F.col("p.a").alias("u"), F.col("p.b").alias("v"), F.lit(1).alias("direction"))
    backward = F.struct(F.col("p.b").alias("u"), F.col("p.a").alias("v"), F.lit(-1).alias("direction"))
    both = F.when(side.isin("yes", "true", "1"), F.array(forward)).when(side == "-1", F.array(backward)).otherwise(F.array(forward, backward))
    return rows.select("way_id", "seq", *keep, F.explode(both).alias("e")).select("way_id", "seq", "e.*", *keep)


def unique_nodes(nodes: DataFrame, key: str = "id") -> DataFrame:
    """One row for each id, the one with the smallest other columns, so joins never multiply edges."""
    rest = [c for c in nodes.columns if c != key]
    return nodes.groupBy(key).agg(F.min(F.struct(*rest)).alias("r")).select(key, *(F.col(f"r.{c}").alias(c) for c in rest))


def shard_nodes(nodes: DataFrame) -> DataFrame:
    """Located nodes (id, x, y, shard_id)."""
    return nodes.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumn("shard_id", geo.s2_cell(F.col("y"), F.col("x")))


def attach(edges: DataFrame, nodes: DataFrame, on_missing: str = "drop") -> DataFrame:
    """Edges with x_u, y_u, shard_u, x_v, y_v, shard_v from sharded nodes; missing ends drop or fail."""
    def side(s: str) -> DataFrame:
        return nodes.select(F.col("id").alias(s), *(F.col(c).alias(f"{n}_{s}") for c, n in (("x", "x"), ("y", "y"), ("shard_id", "shard"))))

    if on_missing == "drop":
        return edges.join(side("u"), "u").join(side("v"), "v")
    rows = edges.join(side("u"), "u", "left").join(side("v"), "v", "left")
    missing = F.col("shard_u").isNull() | F.col("shard_v").isNull()
    return rows.withColumn("shard_u", F.when(missing, F.raise_error(F.format_string("edge %s -> %s has no node", "u", "v")).cast("long")).otherwise(F.col("shard_u")))


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that no node has, and which end (u before v)."""
    ids = nodes.select("id").distinct()
    rows = edges.join(ids.withColumnRenamed("id", "iu"), F.col("u") == F.col("iu"), "left").join(ids.withColumnRenamed("id", "iv"), F.col("v") == F.col("iv"), "left")
    return rows.where("iu is null or iv is null").withColumn("missing", F.when(F.col("iu").isNull(), "u").otherwise("v")).drop("iu", "iv")


def edge_kph() -> Column:
    default = roads.default_kph(*(F.col(c) for c in ("highway", "surface", "tracktype", "service")))
    return roads.chosen_kph(F.col("direction"), *(roads.maxspeed_kph(F.col(c)) for c in ("maxspeed", "maxspeed_forward", "maxspeed_backward")), default)


def weighted(edges: DataFrame, mode: str = "time_s") -> DataFrame:
    """Attached edges with their integer weight, in seconds (time_s) or metres (distance_m)."""
    length = geo.distance_m(F.col("x_u"), F.col("y_u"), F.col("x_v"), F.col("y_v"))
    if mode not in ("time_s", "distance_m"):
        raise ValueError(f"unknown weight mode: {mode}")
    return edges.withColumn("weight", roads.seconds(length, edge_kph()) if mode == "time_s" else roads.whole(length))


def internal(edges: DataFrame) -> DataFrame:
    return edges.where("shard_u = shard_v")


def bridges(edges: DataFrame) -> DataFrame:
    return edges.where("shard_u <> shard_v")


def boundary_in(edges: DataFrame) -> DataFrame:
    return bridges(edges).select(F.col("shard_v").alias("shard_id"), F.col("v").alias("node_id")).distinct()


def boundary_out(edges: DataFrame) -> DataFrame:
    return bridges(edges).select(F.col("shard_u").alias("shard_id"), F.col("u").alias("node_id")).distinct()


def boundary_locations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(shard_id, node_id, x, y) of boundary nodes on either side; unlocated ones are left out."""
    both = boundary_in(edges).union(boundary_out(edges)).distinct()
    return both.join(nodes.select(F.col("id").alias("node_id"), "x", "y"), "node_id").select("shard_id", "node_id", "x", "y")


def shard_graphs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each shard: nested edges, locations, and sorted boundary ids."""
    parts = [
        internal(edges).groupBy(F.col("shard_u").alias("shard_id")).agg(F.array_sort(F.collect_list(F.struct("u", "v", "weight"))).alias("edges")),
        nodes.groupBy("shard_id").agg(F.array_sort(F.collect_list(F.struct("id", "x", "y"))).alias("locations")),
        boundary_in(edges).groupBy("shard_id").agg(F.array_sort(F.collect_list("node_id")).alias("boundary_in")),
        boundary_out(edges).groupBy("shard_id").agg(F.array_sort(F.collect_list("node_id")).alias("boundary_out")),
    ]
    out = parts[1]
    for p in (parts[0], parts[2], parts[3]):
        out = out.join(p, "shard_id", "left")
    return out


def cheapest(edges: DataFrame) -> DataFrame:
    """(u, v, weight): of parallel edges the one with the least weight."""
    return edges.groupBy("u", "v").agg(F.min("weight").alias("weight"))


def overlay_locations(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, x, y) of the overlay's boundary nodes, once each; unlocated ones are left out."""
    return boundary_locations(edges, nodes).select("node_id", "x", "y").distinct()


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(*(F.col({"u": "v", "v": "u"}.get(c, c)).alias(c) for c in edges.columns))
