"""Files, codecs, tiles and jobs: round trips, corrupt input, the reference cases of SURVEY."""

import os
import shutil

import duckdb
import pytest
from pyspark.sql import functions as F

from roadspark import jobs
from roadspark.functions import geo, roads
from roadspark.operators import graph, paths, routing, stats, tiles
from roadspark.plans import fixtures as fx
from roadspark.scratch import Keeper
from roadspark.sources import codec, files, pbf

SF = "/root/testdata/sf0.001"
EDGES = [(1, 2, 10), (1, 3, 20), (2, 3, 5), (2, 4, 15), (3, 4, 10)]


@pytest.fixture(scope="module")
def kept(spark):
    keep = Keeper(spark)
    nodes = keep(graph.shard_nodes(graph.unique_nodes(fx.nodes(spark, SF))), "nodes")
    edges = keep(graph.weighted(graph.attach(graph.way_edges(fx.ways(spark, SF)), nodes)).select("u", "v", "weight", "shard_u", "shard_v"), "edges")
    return nodes, edges


def test_codec():
    made = b"".join(codec.encoded("edge", True, u, v, w, None, None) for u, v, w in EDGES)
    made += codec.encoded("node", True, (1 << 63) - 1, None, None, -0.1, 51.5) + codec.encoded("node", True, 0, None, None, 0.0, 0.0) + codec.ids(codec.IN, [1, 2]) + codec.encoded("out", True, 3, None, None, None, None)
    rows = list(codec.shard_rows(made))
    assert [r[1:4] for r in rows if r[0] == "edge"] == EDGES and ("node", (1 << 63) - 1, None, None, -0.1, 51.5) in rows
    assert [(r[0], r[1]) for r in rows[-3:]] == [("in", 1), ("in", 2), ("out", 3)] and rows[-4][1:] == (0, None, None, 0.0, 0.0)
    # bytes as the format lays them down: tag, length, fixed64, fixed64, varint
    assert codec.encoded("edge", True, 1, 2, 300, None, None).hex() == "0a15" + "09" + "01" + "00" * 7 + "11" + "02" + "00" * 7 + "18" + "ac02"
    with pytest.raises(ValueError):
        codec.edge(1, 2, 1 << 32)
    with pytest.raises(ValueError):
        list(codec.fields(b"\x0a\x05abc"))


def test_codec_as_protobuf():
    pytest.importorskip("google.protobuf")
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    kind = descriptor_pb2.FieldDescriptorProto
    file = descriptor_pb2.FileDescriptorProto(name="g.proto", package="g", syntax="proto3")
    for name, own in {"Edge": [("a", 1, kind.TYPE_FIXED64), ("b", 2, kind.TYPE_FIXED64), ("w", 3, kind.TYPE_UINT32), ("t", 4, kind.TYPE_BOOL)], "Node": [("id", 1, kind.TYPE_FIXED64), ("x", 2, kind.TYPE_DOUBLE), ("y", 3, kind.TYPE_DOUBLE)]}.items():
        m = file.message_type.add(name=name)
        for n, k, t in own:
            m.field.add(name=n, number=k, type=t, label=kind.LABEL_OPTIONAL)
    m = file.message_type.add(name="Graph")
    for n, k, t in (("edges", 1, ".g.Edge"), ("nodes", 2, ".g.Node")):
        m.field.add(name=n, number=k, type=kind.TYPE_MESSAGE, type_name=t, label=kind.LABEL_REPEATED)
    for n, k in (("ins", 3), ("outs", 4)):
        m.field.add(name=n, number=k, type=kind.TYPE_FIXED64, label=kind.LABEL_REPEATED)
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    Graph = message_factory.GetMessageClass(pool.FindMessageTypeByName("g.Graph"))
    made = b"".join(codec.encoded("edge", True, *e, None, None) for e in EDGES) + codec.encoded("node", True, 7, None, None, 1.5, -2.5) + codec.encoded("in", True, 1, None, None, None, None) + codec.encoded("in", True, 2, None, None, None, None)
    read = Graph.FromString(made)
    assert [(e.a, e.b, e.w) for e in read.edges] == EDGES and list(read.ins) == [1, 2] and (read.nodes[0].id, read.nodes[0].x) == (7, 1.5)
    assert [r[1:4] for r in codec.shard_rows(read.SerializeToString()) if r[0] == "edge"] == EDGES


def test_pbf(spark, tmp_path):
    nodes, ways = [(1, 20.8, 52.0), (5, -0.1, -51.5), (3, 0.0, 0.0)], [(9, [1, 5, 3], {"highway": "primary", "name": "ż"}), (10, [3, 1], {"highway": "footway"})]
    data = pbf.encode(nodes, ways)
    assert list(pbf.parse(data)) == [("node", n) for n in nodes] + [("way", w) for w in ways]
    for name, content in {"a": data, "b": data[:-9], "c": b"", "d": data[:60] + b"\xff" * 20 + data[80:]}.items():
        (tmp_path / f"{name}.osm.pbf").write_bytes(content)
    rows = pbf.scan(pbf.matched(spark, f"file://{tmp_path}/*.osm.pbf", 3), tuple(roads.DEFAULT_KPH))
    got = {(r.tile[-9:-8], r.kind): r["count"] for r in rows.groupBy("tile", "kind").count().collect()}
    assert got == {("a", "node"): 3, ("a", "way"): 1, ("b", "corrupt"): 1, ("d", "corrupt"): 1}
    with pytest.raises(Exception, match="not a tile file name"):
        tiles.enrich(pbf.nodes(rows), tiles.tile_edges(pbf.ways(rows)))[0].collect()


def test_nested_layout(spark, kept, tmp_path):
    nodes, _ = kept
    files.write_by_shard(nodes, f"file://{tmp_path}/flat", "nodes")
    for shard in (d for d in os.listdir(tmp_path / "flat" / "nodes") if d.startswith("shard_id=")):
        shutil.copytree(tmp_path / "flat" / "nodes" / shard, tmp_path / "nested" / shard / "nodes")
    read = files.read_nested(spark, f"file://{tmp_path}/nested/shard_id=*", "nodes")
    assert sorted(map(tuple, read.select("shard_id", "id").collect())) == sorted(map(tuple, nodes.select("shard_id", "id").collect()))
    found = files.shard_paths(spark, f"file://{tmp_path}/nested/shard_id=*/nodes/*.parquet")
    assert {r.shard_id for r in found.collect()} == {r.shard_id for r in nodes.select("shard_id").distinct().collect()}
    one = nodes.first().shard_id
    plan = files.read_by_shard(spark, f"file://{tmp_path}/flat", "nodes").where(F.col("shard_id") == one)
    assert plan.count() == nodes.where(F.col("shard_id") == one).count()


def test_jobs(spark, tmp_path):
    """The command line, by tables and by tiles, gives the same shards where tiles own everything."""
    base = f"file://{tmp_path}"
    files.write_flat(fx.nodes(spark, SF), f"{base}/nodes")
    files.write_flat(fx.ways(spark, SF), f"{base}/ways")
    jobs.main(["shard", "--nodes", f"{base}/nodes", "--ways", f"{base}/ways", "--output", f"{base}/out", "--weight-mode", "distance_m"])
    jobs.main(["overlay", "--input", f"{base}/out", "--output", f"{base}/serving"])
    assert (tmp_path / "serving" / "graphs" / "overlay_graph.pb").exists()
    nodes, edges, ins, outs = jobs.stored(spark, f"{base}/out")
    assert nodes.count() == 200 and ins.count() == graph.boundary_in(edges).count() and outs.count() > 0
    with pytest.raises(SystemExit):
        jobs.main(["shard", "--output", "x"])
    # one tile around everything owns everything
    name = "tile_51_000000_19_000000_55_000000_23_000000.osm.pbf"
    tags = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, ("highway", "oneway"))), F.array("highway", "oneway")), lambda k, v: v.isNotNull())
    made = pbf.tile_files(fx.nodes(spark, SF), fx.ways(spark, SF).select("way_id", "node_refs", tags.alias("tags")), F.lit(name))
    files.write_bytes(made.withColumn("part", F.lit(0)), f"{tmp_path}/tiles").collect()
    counts = jobs.shard_tiles(spark, f"{base}/tiles/*.osm.pbf", f"{base}/out2").first()
    assert counts.owned_nodes == 200 and counts.missing_u == 0 and jobs.stored(spark, f"{base}/out2")[1].count() == edges.count()


def test_strict_attach(spark, kept):
    nodes, _ = kept
    edges = spark.createDataFrame([(0, 999_999)], "u long, v long")
    assert graph.attach(edges, nodes).count() == 0
    with pytest.raises(Exception, match="has no node"):
        graph.attach(edges, nodes, on_missing="fail").collect()


def test_cases(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("test_cases:\n  - {name: A, category: town, start: {lat: 51.6, lng: 19.3}, end: {lat: 51.7, lng: 19}}\n  - {name: B, category: city, description: big, start: {lat: 1, lng: 2}, end: {lat: 3, lng: 4}}\n")
    cases = files.read_cases(spark, f"file://{tmp_path}/c.yaml")
    assert [r.name for r in files.of_category(cases, "town").collect()] == ["A"] and files.of_category(cases, name="B").first().end_lng == 4.0


def test_relaxed_search_equals_copied(spark, kept):
    """Overlays beyond a task: same weights, and paths that add up."""
    nodes, edges = kept
    keep = Keeper(spark)
    ins, outs = graph.boundary_in(edges), graph.boundary_out(edges)
    overlay = keep(paths.overlay(edges, paths.shortcuts(edges, ins, outs)), "overlay")
    requests = keep(routing.snapped(fx.requests(spark, SF), nodes, keep), "requests")
    one = {r.request_id: r for r in routing.route_cross_shard(requests, edges, overlay, ins, outs, keep).collect()}
    keep = Keeper(spark)
    two = {r.request_id: r for r in routing.route_cross_shard(requests, edges, overlay, ins, outs, keep, most=0).collect()}
    best = {}
    for r in overlay.collect():
        best[r.u, r.v] = min(r.weight, best.get((r.u, r.v), 1 << 60))
    assert {k: r.total_weight for k, r in one.items()} == {k: r.total_weight for k, r in two.items()} and one
    for k, r in two.items():
        if r.waypoints:
            inner = sum(best[a, b] for a, b in zip(r.waypoints[1:-1], r.waypoints[2:-1]))
            assert inner <= r.total_weight and r.waypoints[0] == one[k].waypoints[0]


def test_snap(spark):
    """Far nodes, ties, shards without a node, missing places; against all pairs."""
    import random

    rng = random.Random(7)
    nodes = spark.createDataFrame([(i, rng.uniform(20.0, 21.0), rng.uniform(52.0, 52.6)) for i in range(40)] + [(100, 20.5, 52.3), (101, 20.5, 52.3)], "id long, x double, y double")
    nodes = graph.shard_nodes(nodes)
    points = spark.createDataFrame([(i, rng.uniform(51.9, 52.7), rng.uniform(19.9, 21.1)) for i in range(80)] + [(80, 52.3, 20.5), (81, None, 20.0)], "k long, lat double, lng double")
    got = {r.k: r.node_id for r in routing.snap(points, nodes, ["k"], Keeper(spark)).collect()}
    cells = {r.k: r.c for r in points.select("k", geo.s2_cell(F.col("lat"), F.col("lng")).alias("c")).collect()}
    known = nodes.collect()
    for p in points.collect():
        near = sorted(((n.y - p.lat) ** 2 + (n.x - p.lng) ** 2, n.id) for n in known if n.shard_id == cells[p.k]) if p.lat is not None else []
        assert got.get(p.k) == (near[0][1] if near else None)
    assert got[80] == 100


def test_expand_batch(spark, kept):
    """The four-node shard: a path, no path, another shard, a shard that isn't known; a failure moves no other."""
    at = [(1, -0.10, 51.50), (2, -0.09, 51.50), (3, -0.10, 51.51), (4, -0.09, 51.51)]
    nodes = graph.shard_nodes(spark.createDataFrame(at, "id long, x double, y double"))
    cell = nodes.first().shard_id
    edges = spark.createDataFrame([(*e, cell, cell) for e in EDGES], "u long, v long, weight long, shard_u long, shard_v long")
    place = {i: (y, x) for i, x, y in at}
    asked = [(7, 0, 1, *place[1], 4, *place[4]), (7, 1, 4, *place[4], 1, *place[1]), (7, 2, 1, *place[1], 9, 48.8, 2.3), (7, 3, 9, 48.8, 2.3, 9, 48.8, 2.3), (7, 4, 2, *place[2], 3, *place[3])]
    frame = spark.createDataFrame(asked, "request_id long, index int, start_id long, start_lat double, start_lng double, end_id long, end_lat double, end_lng double")
    done, errors = routing.expand_batch(frame, nodes, edges, Keeper(spark))
    got = {r["index"]: r for r in done.collect()}
    assert {r["index"]: r.error for r in errors.collect()} == {1: "path_not_found", 3: "shard_not_loaded"}
    assert got[0].total_weight == 25 and len(got[0].polyline) in (3, 4) and got[4].total_weight == 5
    assert got[2].total_weight is None and [(p.lat, p.lng) for p in got[2].polyline] == [(51.5, -0.1), (48.8, 2.3)] and not got[2].expandable
    back = {r["index"]: r.weight for r in routing.reattached(frame, done).collect()}
    assert back == {0: 25, 1: None, 2: None, 3: None, 4: 5}


def test_ranks(spark):
    """Nearest ranks of skewed groups with ties, against sorted lists."""
    import random

    rng = random.Random(3)
    rows = [("a", float(rng.randint(0, 5))) for _ in range(400)] + [("b", rng.random()) for _ in range(101)] + [(None, 1.0), ("c", None)]
    places = {"low": lambda n: F.floor((n - 1) / 2), "p95": lambda n: stats.rank(n, 0.95)}
    got = {r.k: (r.low, r.p95) for r in stats.at_ranks(spark.createDataFrame(rows, "k string, v double"), ["k"], "v", places, Keeper(spark)).collect()}
    for k in ("a", "b", None):
        own = sorted(v for g, v in rows if g == k and v is not None)
        assert got[k] == (own[(len(own) - 1) // 2], own[min(int(len(own) * 0.95), len(own) - 1)])
    assert "c" not in got


def test_split(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.random() ** 3 * 4, rng.random() * 2) for _ in range(3000)]
    leaves = tiles.split(spark.createDataFrame(rows, "x double, y double"), (0.0, 0.0, 4.0, 2.0), 200).collect()
    assert sum(r.points for r in leaves) == 3000 and max(r.points for r in leaves) <= 200 and len({r.tile for r in leaves}) == len(leaves) > 9
    assert sum((r.max_lon - r.min_lon) * (r.max_lat - r.min_lat) for r in leaves) == pytest.approx(8)
    for r in leaves[:6]:
        assert r.points == sum(r.min_lon <= x < r.max_lon and r.min_lat <= y < r.max_lat for x, y in rows)


def test_weights(spark):
    speeds = [("residential", None, None, 35.0), ("residential", "gravel", None, 30.0), ("service", None, "driveway", 10.0), ("other", None, None, 30.0)]
    rows = spark.createDataFrame(speeds, "h string, s string, d string, want double")
    assert all(r.got == r.want for r in rows.select("want", roads.default_kph(F.col("h"), F.col("s"), F.lit(None).cast("string"), F.col("d")).alias("got")).collect())
    one = spark.range(1).select(geo.distance_m(F.lit(0.0), F.lit(0.0), F.lit(0.001), F.lit(0.0)).alias("m"), roads.seconds(F.lit(1000.0), F.lit(36.0)).alias("s"), roads.chosen_kph(F.lit(1), F.lit(70.0), F.lit(80.0), F.lit(60.0), F.lit(80.0)).alias("f"), roads.chosen_kph(F.lit(-1), F.lit(70.0), F.lit(80.0), F.lit(60.0), F.lit(80.0)).alias("b")).first()
    assert one.m == pytest.approx(111, abs=2) and one.s == 100 and (one.f, one.b) == (80.0, 60.0)
    ways = spark.createDataFrame([(1, [1, 2, 3], "YES"), (2, [1, 2, 3], "-1"), (3, [1, 2], None), (4, [1], None), (5, [], "1")], "way_id long, node_refs array<long>, oneway string")
    got = {(r.way_id, r.u, r.v, r.direction) for r in graph.way_edges(ways, keep=(), only_driveable=False).collect()}
    assert got == {(1, 1, 2, 1), (1, 2, 3, 1), (2, 2, 1, -1), (2, 3, 2, -1), (3, 1, 2, 1), (3, 2, 1, -1)}


def test_oracle_cells_agree_all_over_the_world(spark):
    from roadspark.plans import catalog

    con = duckdb.connect()
    con.execute(f"CREATE VIEW nation AS SELECT * FROM '{SF}/nation.parquet'")
    want = {r[0]: r[1:] for r in con.execute(catalog.oracle_sql()["world_cells"]).fetchall()}
    got = {r.n: (r.shard_id, r.shard_text, r.from_path) for r in catalog.world_cells(spark, SF).collect()}
    assert got == want and len({v[1][:2] for v in got.values()}) > 5
