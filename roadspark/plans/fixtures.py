"""A road grid, requests and a query log derived from the given tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.functions import geo

# The oracles have their constants from here, not from the code they check.
KPH_OF = {
    "motorway": 110, "motorway_link": 70, "trunk": 90, "trunk_link": 60, "primary": 80, "primary_link": 50, "secondary": 70, "secondary_link": 50, "tertiary": 60, "tertiary_link": 40,
    "unclassified": 50, "residential": 35, "living_street": 10, "service": 20, "road": 40,
}
SURFACE_CAP = {"unpaved": 30, "gravel": 30, "ground": 25, "dirt": 20, "sand": 15, "mud": 10}
TRACK_CAP = {"grade1": 40, "grade2": 30, "grade3": 20, "grade4": 15, "grade5": 10}
SERVICE_CAP = {"parking_aisle": 10, "driveway": 10, "alley": 15}
RADIUS_M, MPH_KPH = 6371000, 1.60934
CURVE, TURNS = [0, 1, 3, 2, 0, 3, 1, 2, 2, 3, 1, 0, 2, 1, 3, 0], [1, 0, 0, 3]
HIGHWAYS = list(KPH_OF)
MAXSPEED = [None, "50", "30 mph", "signals", "90", "none", "50.5"]
SURFACE = [None, "gravel", "asphalt", "mud"]
SERVICE = [None, "driveway", "alley", "parking_aisle", "drive-through"]
TRACK = [None, "grade1", "grade3"]
ONEWAY = ["yes", "-1", None, None, None]
WORKERS = [f"worker-{i}:50051" for i in range(4)]


def _pick(values: list, key: str):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values)).cast("int") + 1)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("long")
    return spark.read.parquet(f"{sf}/part.parquet").select(k.alias("id"), ((k % 40 + 2080) / F.lit(100.0)).alias("x"), ((F.floor(k / 40) + 5200) / F.lit(100.0)).alias("y"))


def ways(spark: SparkSession, sf: str) -> DataFrame:
    k = nodes(spark, sf).select(F.col("id").alias("k"))
    row, column = F.floor(F.col("k") / 40), F.col("k") % 40
    ids = F.array(row, column + 100000, F.when(row % 5 == 0, row + 200000))
    refs = k.select(F.explode(F.array_compact(ids)).alias("way_id"), "k").groupBy("way_id").agg(F.array_sort(F.collect_list("k")).alias("node_refs"))
    return refs.select(
        F.col("way_id").cast("long").alias("way_id"), "node_refs", F.when(F.col("way_id") >= 200000, "footway").otherwise(_pick(HIGHWAYS, "way_id")).alias("highway"),
        _pick(ONEWAY, "way_id").alias("oneway"), _pick(MAXSPEED, "way_id").alias("maxspeed"), F.when(F.col("way_id") % 3 == 1, "80").alias("maxspeed_forward"),
        F.when(F.col("way_id") % 4 == 1, "0").when(F.col("way_id") % 4 == 2, "60").alias("maxspeed_backward"),
        _pick(SURFACE, "way_id").alias("surface"), _pick(TRACK, "way_id").alias("tracktype"), _pick(SERVICE, "way_id").alias("service"),
    )


def requests(spark: SparkSession, sf: str) -> DataFrame:
    """One request for each customer."""
    n = spark.read.parquet(f"{sf}/part.parquet").agg(F.count("*").alias("n"))
    c = spark.read.parquet(f"{sf}/customer.parquet").select(F.col("c_custkey").cast("long").alias("request_id")).crossJoin(F.broadcast(n))

    def place(k, e: str) -> list:
        return [(F.floor(k / 40) + 5200) / F.lit(100.0) + 0.003, (k % 40 + 2080) / F.lit(100.0) + 0.002]

    a, b = place(F.col("request_id") * 7919 % F.col("n"), "start"), place(F.col("request_id") * 104729 % F.col("n"), "end")
    return c.select("request_id", a[0].alias("start_lat"), a[1].alias("start_lng"), b[0].alias("end_lat"), b[1].alias("end_lng"))


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tile names (tile) that cover the grid in bands of a fifth of a degree, each wider by the overlap."""
    rows = nodes(spark, sf).select(F.floor((F.col("y") - 52.0) / 0.2).cast("int").alias("band")).distinct()
    low = F.lit(52.0) + F.col("band") * 0.2 - 0.017966
    return rows.select(geo.tile_name(low, F.lit(20.7), low + 0.235932, F.lit(21.3)).alias("tile"))


def query_log(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select(
        F.col("event_id").cast("long").alias("request_id"), F.col("event_type").alias("category"), F.concat(F.lit("case_"), (F.col("user_id") % 9).cast("string")).alias("test_case"),
        F.when(F.col("event_id") % 2 == 0, "first").otherwise("cached").alias("query_type"), F.col("value").cast("double").alias("latency_ms"),
        (F.col("event_type") != "error").alias("success"), (F.col("event_id") % 5 != 0).alias("path_found"),
        F.get_json_object("props", "$.k").cast("double").alias("distance_m"), F.col("ts").cast("timestamp").alias("start_time"),
    )


def _case(values: dict[str, float], key: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in values.items()) + " END"


def _list(values: list, key: str) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"][{key} % {len(values)} + 1]"


def unsigned_sql(cell: str) -> str:
    return f"(CASE WHEN {cell} < 0 THEN {cell}::HUGEINT + 18446744073709551616 ELSE {cell}::HUGEINT END)::VARCHAR"


def cell_sql(source: str, lat: str, lng: str, name: str) -> str:
    """CTEs that add shard_id to a source."""
    steps = []
    table = str(CURVE)
    last = f"{name}_9"
    for b in range(8, -1, -1):
        now = f"{name}_{b}"
        steps.append(f"{now} AS (SELECT * EXCLUDE (o, pos, d), o AS o0, xor(o, {TURNS}[d + 1]) AS o, pos * 4 + d AS pos FROM (SELECT * {'' if b == 8 else 'EXCLUDE (o0)'}, {table}[o * 4 + ((ci >> {b}) & 1) * 2 + ((cj >> {b}) & 1) + 1] AS d FROM {last}))")
        last = now
    return f"""
{name}_a AS (SELECT *, cos(radians({lat})) * cos(radians({lng})) AS px, cos(radians({lat})) * sin(radians({lng})) AS py, sin(radians({lat})) AS pz FROM {source}),
{name}_b AS (SELECT *, CASE WHEN abs(px) > abs(py) AND abs(px) > abs(pz) THEN 0 WHEN abs(py) > abs(pz) THEN 1 ELSE 2 END AS ax FROM {name}_a),
{name}_c AS (SELECT *, CASE WHEN (CASE ax WHEN 0 THEN px WHEN 1 THEN py ELSE pz END) < 0 THEN ax + 3 ELSE ax END AS f FROM {name}_b),
{name}_d AS (SELECT *, CASE f WHEN 0 THEN py / px WHEN 1 THEN -px / py WHEN 2 THEN -px / pz WHEN 3 THEN pz / px WHEN 4 THEN pz / py ELSE -py / pz END AS cu,
  CASE f WHEN 0 THEN pz / px WHEN 1 THEN pz / py WHEN 2 THEN -py / pz WHEN 3 THEN py / px WHEN 4 THEN -px / py ELSE -px / pz END AS cv FROM {name}_c),
{name}_9 AS (SELECT *, greatest(0, least(511, floor(512 * CASE WHEN cu >= 0 THEN 0.5 * sqrt(1 + 3 * cu) ELSE 1 - 0.5 * sqrt(1 - 3 * cu) END)))::BIGINT AS ci,
  greatest(0, least(511, floor(512 * CASE WHEN cv >= 0 THEN 0.5 * sqrt(1 + 3 * cv) ELSE 1 - 0.5 * sqrt(1 - 3 * cv) END)))::BIGINT AS cj, f & 1 AS o, 0::BIGINT AS pos FROM {name}_d),
{", ".join(steps)},
{name} AS (SELECT * EXCLUDE (px, py, pz, ax, f, cu, cv, ci, cj, o, o0, pos), (CASE f WHEN 0 THEN 0::HUGEINT WHEN 1 THEN 2305843009213693952 WHEN 2 THEN 4611686018427387904 WHEN 3 THEN 6917529027641081856 WHEN 4 THEN -9223372036854775808 ELSE -6917529027641081856 END + pos::HUGEINT * 8796093022208 + 4398046511104)::BIGINT AS shard_id FROM {name}_0)"""


KPH = f"""least(coalesce(CASE WHEN direction > 0 THEN nullif(sf, 0) ELSE nullif(sb, 0) END, sm),
  coalesce({_case(KPH_OF, 'highway')}, 30), {_case(SURFACE_CAP, 'surface')}, {_case(TRACK_CAP, 'tracktype')}, {_case(SERVICE_CAP, 'service')})"""


def _speed(c: str) -> str:
    n = f"TRY_CAST(nullif(regexp_extract({c}, '([0-9]+)', 1), '') AS DOUBLE)"
    return f"CASE WHEN lower(trim({c})) IN ('signals', 'walk', 'none', 'variable', 'unposted', 'unknown') THEN NULL WHEN lower({c}) LIKE '%mph%' THEN {n} * {MPH_KPH}::DOUBLE ELSE {n} END"


#: CTEs: nodes (with shard_id), ways, edges (way_id, seq, u, v, direction, tags) and attached (with ends, kph and weights).
SQL = f"""
grid AS (SELECT p_partkey::BIGINT AS id, (2080 + p_partkey % 40) / 100.0::DOUBLE AS x, (5200 + p_partkey // 40) / 100.0::DOUBLE AS y FROM part),
{cell_sql('grid', 'y', 'x', 'nodes')},
members AS (SELECT id // 40 AS way_id, id AS k FROM grid UNION ALL SELECT 100000 + id % 40, id FROM grid UNION ALL SELECT 200000 + id // 40, id FROM grid WHERE (id // 40) % 5 = 0),
tagged AS (SELECT way_id::BIGINT AS way_id, k, CASE WHEN way_id >= 200000 THEN 'footway' ELSE {_list(HIGHWAYS, 'way_id')} END AS highway, {_list(ONEWAY, 'way_id')} AS oneway,
  {_list(MAXSPEED, 'way_id')} AS maxspeed, CASE WHEN way_id % 3 = 1 THEN '80' END AS maxspeed_forward, CASE way_id % 4 WHEN 1 THEN '0' WHEN 2 THEN '60' END AS maxspeed_backward,
  {_list(SURFACE, 'way_id')} AS surface, {_list(TRACK, 'way_id')} AS tracktype, {_list(SERVICE, 'way_id')} AS service,
  (row_number() OVER (PARTITION BY way_id ORDER BY k) - 1)::INTEGER AS seq, lead(k) OVER (PARTITION BY way_id ORDER BY k) AS nk FROM members),
pairs AS (SELECT * FROM tagged WHERE nk IS NOT NULL AND highway <> 'footway'),
edges AS (SELECT * EXCLUDE (k, nk, oneway), k AS u, nk AS v, 1 AS direction FROM pairs WHERE oneway IS DISTINCT FROM '-1'
  UNION ALL SELECT * EXCLUDE (k, nk, oneway), nk, k, -1 FROM pairs WHERE oneway IS DISTINCT FROM 'yes'),
attached0 AS (SELECT e.*, a.x AS x_u, a.y AS y_u, a.shard_id AS shard_u, b.x AS x_v, b.y AS y_v, b.shard_id AS shard_v,
  radians(b.x - a.x) * cos((radians(a.y) + radians(b.y)) / 2) * {RADIUS_M}::DOUBLE AS dx, radians(b.y - a.y) * {RADIUS_M}::DOUBLE AS dy,
  {_speed('maxspeed')} AS sm, {_speed('maxspeed_forward')} AS sf, {_speed('maxspeed_backward')} AS sb
  FROM edges e JOIN nodes a ON e.u = a.id JOIN nodes b ON e.v = b.id),
attached AS (SELECT *, {KPH} AS kph, round_even(sqrt(dx * dx + dy * dy), 0)::BIGINT AS metres,
  CASE WHEN {KPH} <= 0 THEN 0 ELSE round_even(sqrt(dx * dx + dy * dy) / ({KPH} * (1000.0::DOUBLE / 3600.0::DOUBLE)), 0)::BIGINT END AS weight FROM attached0)"""
