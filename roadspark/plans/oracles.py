"""DuckDB SQL of the catalog's queries."""

from __future__ import annotations

from . import fixtures as fx

OVERLAP_DEG = "(2.0::DOUBLE / 111.32::DOUBLE)"

GRAPH = f"WITH RECURSIVE {fx.SQL}"
LOG = """
WITH log AS (SELECT event_id::BIGINT AS request_id, event_type AS category, 'case_' || (user_id % 9) AS test_case, CASE WHEN event_id % 2 = 0 THEN 'first' ELSE 'cached' END AS query_type,
  value::DOUBLE AS latency_ms, event_type <> 'error' AS success, event_id % 5 <> 0 AS path_found, (props->>'$.k')::DOUBLE AS distance_m, ts AS start_time FROM events)"""
TILES = """
WITH t AS (SELECT n_nationkey::INTEGER AS n, round(51.5::DOUBLE + (n_nationkey % 5) * 0.25::DOUBLE, 6) AS a, round(-1.0::DOUBLE + (n_nationkey // 5) * 5.5::DOUBLE, 6) AS b FROM nation),
tiles AS (SELECT n, 'tile_' || array_to_string(list_transform([a, b, round(a + 0.535932::DOUBLE, 6), round(b + 5.535932::DOUBLE, 6)], lambda v: replace(replace(printf('%.6f', v), '-', 'm'), '.', '_')), '_') || '.osm.pbf' AS name FROM t),
boxes AS (SELECT n, name, list_transform(regexp_extract_all(name, 'm?\\d+_\\d+'), lambda p: replace(replace(p, 'm', '-'), '_', '.')::DOUBLE) AS c FROM tiles)"""
ENDS = """
seeds AS (SELECT DISTINCT shard_v AS s, v AS src FROM attached WHERE shard_u <> shard_v),
goals AS (SELECT DISTINCT shard_u AS s, u AS dst FROM attached WHERE shard_u <> shard_v),
r(s, src, n, dist) USING KEY (s, src, n) AS (
  SELECT s, src, src, 0::BIGINT FROM seeds
  UNION (SELECT r.s, r.src, e.v, min(r.dist + e.weight) FROM r JOIN attached e ON e.shard_u = r.s AND e.shard_v = r.s AND e.u = r.n
         LEFT JOIN recurring.r x ON x.s = r.s AND x.src = r.src AND x.n = e.v GROUP BY r.s, r.src, e.v, x.dist HAVING x.dist IS NULL OR min(r.dist + e.weight) < x.dist)),
found AS (SELECT r.s AS shard_id, r.src, r.n AS dst, r.dist::BIGINT AS weight FROM r JOIN goals ON goals.s = r.s AND goals.dst = r.n WHERE r.src <> r.n)"""
SNAP = f"""
, asked AS (SELECT c_custkey::BIGINT AS request_id, c_custkey::BIGINT * 7919 % (SELECT count(*) FROM part) AS a, c_custkey::BIGINT * 104729 % (SELECT count(*) FROM part) AS b FROM customer),
points AS (SELECT request_id, 'start' AS e, (5200 + a // 40) / 100.0::DOUBLE + 0.003::DOUBLE AS lat, (2080 + a % 40) / 100.0::DOUBLE + 0.002::DOUBLE AS lng FROM asked
  UNION ALL SELECT request_id, 'end', (5200 + b // 40) / 100.0::DOUBLE + 0.003::DOUBLE, (2080 + b % 40) / 100.0::DOUBLE + 0.002::DOUBLE FROM asked),
{fx.cell_sql('points', 'lat', 'lng', 'located')},
snaps AS (SELECT request_id, e, l.shard_id, arg_min(id, (power(y - lat, 2) + power(x - lng, 2), id)) AS id FROM located l JOIN nodes n ON n.shard_id = l.shard_id GROUP BY ALL)"""
HOPS = ", ".join(f"h{k} AS (SELECT node, min(dist)::BIGINT AS dist FROM (SELECT * FROM h{k - 1} UNION ALL SELECT v, dist + weight FROM h{k - 1} JOIN attached ON u = node) GROUP BY node)" for k in range(1, 7))
ENDPOINTS = """
reqs AS (SELECT a.request_id, a.id AS start_id, a.shard_id AS s1, b.id AS end_id, b.shard_id AS s2 FROM snaps a JOIN snaps b ON a.request_id = b.request_id AND a.e = 'start' AND b.e = 'end')"""
INSIDE = """
inside(s, src, n, dist) USING KEY (s, src, n) AS (
  SELECT DISTINCT s1, start_id, start_id, 0::BIGINT FROM reqs
  UNION (SELECT r.s, r.src, e.v, min(r.dist + e.weight) FROM inside r JOIN attached e ON e.shard_u = r.s AND e.shard_v = r.s AND e.u = r.n
         LEFT JOIN recurring.inside x ON x.s = r.s AND x.src = r.src AND x.n = e.v GROUP BY r.s, r.src, e.v, x.dist HAVING x.dist IS NULL OR min(r.dist + e.weight) < x.dist))"""
FLAT = """
flat(src, n, dist) USING KEY (src, n) AS (
  SELECT DISTINCT start_id, start_id, 0::BIGINT FROM reqs WHERE s1 <> s2
  UNION (SELECT r.src, e.v, min(r.dist + e.weight) FROM flat r JOIN attached e ON e.u = r.n
         LEFT JOIN recurring.flat x ON x.src = r.src AND x.n = e.v GROUP BY r.src, e.v, x.dist HAVING x.dist IS NULL OR min(r.dist + e.weight) < x.dist))"""
CROSS = f"{GRAPH}{SNAP}, {ENDPOINTS}, {FLAT}, crossed AS (SELECT request_id, start_id, end_id, dist::BIGINT AS total_weight FROM reqs LEFT JOIN flat ON src = start_id AND n = end_id WHERE s1 <> s2)"
SAME = f"{GRAPH}{SNAP}, {ENDPOINTS}, {INSIDE}, same AS (SELECT request_id, start_id, end_id, dist::BIGINT AS total_weight FROM reqs LEFT JOIN inside ON s = s1 AND src = start_id AND n = end_id WHERE s1 = s2)"
TIME = "CASE WHEN {m} // 60 = 0 THEN {m} || ' min' WHEN {m} % 60 = 0 THEN {m} // 60 || ' h' ELSE {m} // 60 || ' h ' || {m} % 60 || ' min' END"
MINUTES = "floor({x} / 60.0::DOUBLE + 0.5::DOUBLE)::BIGINT"
CUT = f"""{GRAPH},
bands AS (SELECT DISTINCT floor((y - 52.0::DOUBLE) / 0.2::DOUBLE)::INTEGER AS band FROM grid),
lows AS (SELECT 52.0::DOUBLE + band * 0.2::DOUBLE - 0.017966::DOUBLE AS lo FROM bands),
cuts AS (SELECT 'tile_' || array_to_string(list_transform([lo, 20.7::DOUBLE, lo + 0.235932::DOUBLE, 21.3::DOUBLE], lambda v: replace(replace(printf('%.6f', v), '-', 'm'), '.', '_')), '_') || '.osm.pbf' AS tile,
  round(lo, 6) AS a, round(lo + 0.235932::DOUBLE, 6) AS b FROM lows),
inside AS (SELECT tile, id, x, y, shard_id, y >= a + {OVERLAP_DEG} AND y < b - {OVERLAP_DEG} AND x >= 20.7::DOUBLE + {OVERLAP_DEG} AND x < 21.3::DOUBLE - {OVERLAP_DEG} AS own FROM nodes JOIN cuts ON y >= a AND y < b),
touched AS (SELECT DISTINCT tile, way_id FROM members JOIN inside ON k = id),
cut_edges AS (SELECT t.tile, e.way_id, e.u, e.v, e.direction, p.id IS NULL AS no_u, q.id IS NULL AS no_v, p.own, p.shard_id AS shard_u, q.shard_id AS shard_v
  FROM touched t JOIN edges e ON e.way_id = t.way_id LEFT JOIN inside p ON p.tile = t.tile AND p.id = e.u LEFT JOIN inside q ON q.tile = t.tile AND q.id = e.v),
lost AS (SELECT DISTINCT tile, 'u' AS side, u AS node FROM cut_edges WHERE no_u UNION ALL SELECT DISTINCT tile, 'v', v FROM cut_edges WHERE no_v),
samples AS (SELECT tile, coalesce(array_to_string(list_sort(list(node) FILTER (side = 'u'))[1:5], ','), '') AS sample_u, coalesce(array_to_string(list_sort(list(node) FILTER (side = 'v'))[1:5], ','), '') AS sample_v FROM lost GROUP BY tile),
per AS (SELECT tile, (SELECT count(*) FROM inside i WHERE i.tile = c.tile)::BIGINT AS tile_nodes, (SELECT count(*) FROM inside i WHERE i.tile = c.tile AND own)::BIGINT AS owned_nodes,
  (SELECT count(*) FROM cut_edges e WHERE e.tile = c.tile)::BIGINT AS tile_edges, (SELECT count(*) FROM cut_edges e WHERE e.tile = c.tile AND NOT no_u AND NOT no_v AND own)::BIGINT AS owned_edges,
  (SELECT count(*) FROM cut_edges e WHERE e.tile = c.tile AND no_u)::BIGINT AS missing_u, (SELECT count(*) FROM cut_edges e WHERE e.tile = c.tile AND no_v)::BIGINT AS missing_v FROM cuts c)"""
REGIONS = """
WITH r AS (SELECT r_regionkey::INTEGER AS region, r_regionkey * 3 - 4.0::DOUBLE AS w, r_regionkey * 2 + 50.0::DOUBLE AS s, r_regionkey * 3 - 2.25::DOUBLE AS e, r_regionkey * 2 + 51.3::DOUBLE AS n FROM region)"""
WORLD = f"""
WITH places AS (SELECT n_nationkey::BIGINT AS n, n_nationkey * 37 % 160 - 79.5::DOUBLE AS lat, n_nationkey * 101 % 350 - 174.5::DOUBLE AS lng FROM nation),
{fx.cell_sql('places', 'lat', 'lng', 'world')}"""
RANK = "list_sort(list(latency_ms) FILTER (success))[least(floor(n_ok * {p})::BIGINT + 1, n_ok)]"

SORTED = "list_sort(list(latency_ms) FILTER (success))"
MIDDLE = f"({SORTED}[(n_ok - 1) // 2 + 1] + {SORTED}[n_ok // 2 + 1]) / 2"


def _flag(c: str) -> str:
    return f"CASE WHEN {c} THEN 'True' ELSE 'False' END"


def _round(x: str, name: str, digits: int = 2) -> str:
    return f"round_even(coalesce({x}, 0)::DOUBLE, {digits}) AS {name}"


SQL = {
    "way_edges": f"{GRAPH} SELECT way_id, seq, u, v, direction, highway FROM edges",
    "order_way_edges": """
WITH l AS (SELECT l_orderkey::BIGINT AS way_id, l_linenumber, min(l_partkey)::BIGINT AS k FROM lineitem GROUP BY 1, 2),
p AS (SELECT way_id, k, (row_number() OVER w - 1)::INTEGER AS seq, lead(k) OVER w AS nk FROM l WINDOW w AS (PARTITION BY way_id ORDER BY l_linenumber)),
q AS (SELECT p.*, o_orderstatus AS st FROM p JOIN orders ON o_orderkey = way_id WHERE nk IS NOT NULL)
SELECT way_id, seq, k AS u, nk AS v, 1 AS direction FROM q WHERE st <> 'P' UNION ALL SELECT way_id, seq, nk, k, -1 FROM q WHERE st <> 'F'""",
    "edge_speed": f"{GRAPH} SELECT way_id, seq, u, v, direction, round(kph, 6) AS kph FROM attached",
    "edge_weight_time": f"{GRAPH} SELECT way_id, u, v, direction, weight FROM attached",
    "edge_weight_distance": f"{GRAPH} SELECT way_id, u, v, direction, metres AS weight FROM attached",
    "node_shards": f"{GRAPH} SELECT id, shard_id, {fx.unsigned_sql('shard_id')} AS shard_text FROM nodes",
    "tile_bbox_decode": f"{TILES} SELECT n, name, round(c[2], 6) AS min_lon, round(c[1], 6) AS min_lat, round(c[4], 6) AS max_lon, round(c[3], 6) AS max_lat, round(c[2] + {OVERLAP_DEG}::DOUBLE, 6) AS core_min_lon, round(c[1] + {OVERLAP_DEG}::DOUBLE, 6) AS core_min_lat FROM boxes",
    "tile_core_owner": f"""{TILES}, g AS (SELECT p_partkey::BIGINT AS id, (2080 + p_partkey % 40) / 100.0::DOUBLE AS x, (5200 + p_partkey // 40) / 100.0::DOUBLE AS y FROM part)
SELECT name, count(*)::BIGINT AS owned_nodes, min(id) AS first_id, max(id) AS last_id, sum(id)::BIGINT AS sum_id FROM g JOIN boxes
ON x >= c[2] + {OVERLAP_DEG}::DOUBLE AND x < c[4] - {OVERLAP_DEG}::DOUBLE AND y >= c[1] + {OVERLAP_DEG}::DOUBLE AND y < c[3] - {OVERLAP_DEG}::DOUBLE GROUP BY name""",
    "internal_edges": f"{GRAPH} SELECT u, v, weight, shard_u AS shard_id FROM attached WHERE shard_u = shard_v",
    "bridge_edges": f"{GRAPH} SELECT u, v, weight, shard_u, shard_v FROM attached WHERE shard_u <> shard_v",
    "bridge_summary": f"{GRAPH} SELECT shard_u, shard_v, count(*)::BIGINT AS edges, sum(weight)::BIGINT AS total_weight FROM attached WHERE shard_u <> shard_v GROUP BY 1, 2",
    "boundary_in": f"{GRAPH} SELECT DISTINCT shard_v AS shard_id, v AS node_id FROM attached WHERE shard_u <> shard_v",
    "boundary_out": f"{GRAPH} SELECT DISTINCT shard_u AS shard_id, u AS node_id FROM attached WHERE shard_u <> shard_v",
    "boundary_locations": f"{GRAPH} SELECT DISTINCT n.shard_id, id AS node_id, x, y FROM nodes n JOIN (SELECT u AS k FROM attached WHERE shard_u <> shard_v UNION SELECT v FROM attached WHERE shard_u <> shard_v) ON k = id",
    "dangling_edges": f"{GRAPH} SELECT way_id, seq, u, v, direction, CASE WHEN u % 97 = 0 THEN 'u' ELSE 'v' END AS missing FROM edges WHERE u % 97 = 0 OR v % 97 = 0",
    "dedup_nodes_join": f"{GRAPH} SELECT way_id, count(*)::BIGINT AS edges, round(sum(x_u), 6) AS sum_x FROM attached GROUP BY way_id",
    "shard_graph_stats": f"""{GRAPH},
e AS (SELECT shard_u AS s, count(*) AS n FROM attached WHERE shard_u = shard_v GROUP BY 1),
i AS (SELECT s, string_agg(k::VARCHAR, ',' ORDER BY k) AS t FROM (SELECT DISTINCT shard_v AS s, v AS k FROM attached WHERE shard_u <> shard_v) GROUP BY s),
o AS (SELECT s, count(*) AS n FROM (SELECT DISTINCT shard_u AS s, u FROM attached WHERE shard_u <> shard_v) GROUP BY s)
SELECT shard_id, coalesce(any_value(e.n), 0)::BIGINT AS edges, count(*)::BIGINT AS nodes, coalesce(any_value(t), '') AS boundary_in, coalesce(any_value(o.n), 0)::BIGINT AS boundary_out
FROM nodes LEFT JOIN e ON e.s = shard_id LEFT JOIN i ON i.s = shard_id LEFT JOIN o ON o.s = shard_id GROUP BY shard_id""",
    "sssp_nation": """
WITH RECURSIVE e AS (SELECT n_nationkey::BIGINT AS u, (n_nationkey + 1)::BIGINT % 25 AS v, n_nationkey::BIGINT * 13 % 17 AS w FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 7 + 3) % 25, n_nationkey * 13 % 17 FROM nation),
r(source, node, dist) USING KEY (source, node) AS (
  SELECT u, u, 0::BIGINT FROM (SELECT DISTINCT u FROM e)
  UNION (SELECT r.source, e.v, min(r.dist + e.w) FROM r JOIN e ON e.u = r.node LEFT JOIN recurring.r x ON x.source = r.source AND x.node = e.v
         GROUP BY r.source, e.v, x.dist HAVING x.dist IS NULL OR min(r.dist + e.w) < x.dist))
SELECT source, node, dist FROM r""",
    "khop_dist": f"{GRAPH}, h0 AS (SELECT 0::BIGINT AS node, 0::BIGINT AS dist), {HOPS} SELECT node, dist FROM h6",
    "shortcuts": f"{GRAPH}, {ENDS} SELECT * FROM found",
    "overlay_edges": f"{GRAPH}, {ENDS} SELECT u, v, weight, 'bridge' AS kind FROM attached WHERE shard_u <> shard_v UNION ALL SELECT src, dst, weight, 'shortcut' FROM found",
    "snap_requests": f"{GRAPH}{SNAP} SELECT a.request_id, a.id AS start_id, a.shard_id AS start_shard, b.id AS end_id, b.shard_id AS end_shard FROM snaps a JOIN snaps b ON a.request_id = b.request_id AND a.e = 'start' AND b.e = 'end'",
    "hrw_assign": f"{GRAPH}, k AS (SELECT DISTINCT {fx.unsigned_sql('shard_id')} AS key FROM nodes) SELECT key, arg_max(node, substr(sha256(key || '-' || node), 1, 16)) AS node FROM k, (SELECT unnest({fx.WORKERS}) AS node) GROUP BY key",
    "latency_stats": f"""{LOG}, g AS (SELECT *, count(*) FILTER (success) OVER (PARTITION BY category, test_case, query_type) AS n_ok FROM log)
SELECT category, test_case, query_type, count(*)::BIGINT AS run_count, n_ok::BIGINT AS success_count, {_round('avg(latency_ms) FILTER (success)', 'mean_ms')}, {_round('stddev_samp(latency_ms) FILTER (success)', 'std_ms')},
  {_round('min(latency_ms) FILTER (success)', 'min_ms')}, {_round('max(latency_ms) FILTER (success)', 'max_ms')}, round_even(coalesce(round(({MIDDLE}) * 1000) / 10, 0)::DOUBLE, 0) / 100 AS median_ms,
  {_round(RANK.format(p=0.95), 'p95_ms')}, {_round('avg(distance_m) FILTER (success AND path_found)', 'avg_distance_m')} FROM g GROUP BY category, test_case, query_type, n_ok""",
    "load_summary": f"""{LOG}, g AS (SELECT *, count(*) FILTER (success) OVER () AS n_ok, greatest(date_diff('microsecond', min(start_time) OVER (), max(start_time) OVER ()) / 1000000.0::DOUBLE, 0) AS span FROM log)
SELECT count(*)::BIGINT AS total, n_ok::BIGINT AS success_count, {_round('CASE WHEN span > 0 THEN span ELSE 1 END', 'duration_s')}, {_round('count(*) / CASE WHEN span > 0 THEN span ELSE 1 END', 'rps', 6)},
  {_round('avg(latency_ms) FILTER (success)', 'mean_ms')}, {_round('stddev_samp(latency_ms) FILTER (success)', 'std_ms')}, {_round('min(latency_ms) FILTER (success)', 'min_ms')}, {_round('max(latency_ms) FILTER (success)', 'max_ms')},
  {', '.join(_round(RANK.format(p=p / 100), f'p{p}_ms') for p in (50, 95, 99))}, {_round('1 - n_ok / count(*)', 'error_rate', 4)} FROM g GROUP BY n_ok, span""",
    "load_timeline": f"{LOG} SELECT request_id, epoch_us(start_time) AS start_us, round_even(latency_ms, 2) AS latency_ms, success FROM log",
    "category_summary": f"{LOG} SELECT category, query_type, count(*)::BIGINT AS n, round_even(min(latency_ms), 2) AS low, round_even(max(latency_ms), 2) AS high FROM log WHERE success GROUP BY 1, 2",
    "cache_speedup": f"""{LOG}, g AS (SELECT category, test_case, avg(latency_ms) FILTER (query_type = 'first') AS f, avg(latency_ms) FILTER (query_type = 'cached') AS c FROM log WHERE success GROUP BY 1, 2)
SELECT category, test_case, round_even(f, 2) AS first_ms, round_even(c, 2) AS cached_ms, round_even(CASE WHEN c > 0 THEN f / c END, 4) AS ratio, round_even((1 - 1 / CASE WHEN c > 0 THEN f / c END) * 100, 4) AS reduction_pct FROM g""",
}

GRAPH_ROWS = """
SELECT shard_u AS shard_id, 'edge' AS kind, u, v, weight, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM attached WHERE shard_u = shard_v
UNION ALL SELECT shard_id, 'node', id, NULL, NULL, round(x, 6), round(y, 6) FROM nodes
UNION ALL SELECT DISTINCT shard_v, 'in', v, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM attached WHERE shard_u <> shard_v
UNION ALL SELECT DISTINCT shard_u, 'out', u, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE FROM attached WHERE shard_u <> shard_v"""
PLACES = "SELECT DISTINCT id AS node_id, x, y FROM nodes JOIN (SELECT u AS k FROM attached WHERE shard_u <> shard_v UNION SELECT v FROM attached WHERE shard_u <> shard_v) ON k = id"
_LINE = "request_id || chr(9) || (epoch_us(start_time) // 1000000) || '.' || lpad((epoch_us(start_time) % 1000000)::VARCHAR, 6, '0') || chr(9) || printf('%.2f', latency_ms) || chr(9) || " + _flag("success") + " || chr(9)"
_ALL = SQL["latency_stats"]
_LOAD = SQL["load_summary"]
SQL |= {
    "overlay_locations": f"{GRAPH} {PLACES}",
    "snap_boundary_dists": f"{GRAPH}{SNAP}, {ENDPOINTS}, {INSIDE}, outs AS (SELECT DISTINCT shard_u AS os, u AS node FROM attached WHERE shard_u <> shard_v) SELECT request_id, node AS node_id, dist::BIGINT AS dist FROM reqs JOIN inside ON s = s1 AND src = start_id JOIN outs ON os = s AND node = n",
    "route_same_shard": f"{SAME} SELECT * FROM same",
    "route_cross_shard": f"{CROSS} SELECT request_id, total_weight FROM crossed",
    "route_segments": f"{CROSS} SELECT request_id, start_id AS first_id, end_id AS last_id, true AS linked FROM crossed WHERE total_weight IS NOT NULL",
    "expand_segments": f"{CROSS} SELECT request_id, total_weight FROM crossed WHERE total_weight IS NOT NULL",
    "expand_requests": f"""{SAME} SELECT request_id, CASE WHEN total_weight IS NULL THEN 'path_not_found' ELSE 'ok' END AS status, total_weight, total_weight IS NOT NULL AS has_line FROM same
UNION ALL SELECT request_id, 'straight', NULL, true FROM reqs WHERE s1 <> s2""",
    "routes": f"""{GRAPH}{SNAP}, {ENDPOINTS}, {INSIDE}, {FLAT},
every AS (SELECT request_id, start_id, end_id, coalesce(i.dist, f.dist)::BIGINT AS total_weight FROM reqs LEFT JOIN inside i ON s1 = s2 AND i.s = s1 AND i.src = start_id AND i.n = end_id LEFT JOIN flat f ON s1 <> s2 AND f.src = start_id AND f.n = end_id)
SELECT request_id, CASE WHEN total_weight IS NULL THEN 'no_path' ELSE 'ok' END AS status, total_weight IS NOT NULL AS path_found, total_weight, {TIME.format(m=MINUTES.format(x='total_weight'))} AS travel_time,
  CASE WHEN total_weight IS NOT NULL THEN start_id::VARCHAR END AS first_id, CASE WHEN total_weight IS NOT NULL THEN end_id::VARCHAR END AS last_id, total_weight IS NOT NULL AS has_lines FROM every
UNION ALL SELECT -request_id - 1, 'no_start', false, NULL, NULL, NULL, NULL, false FROM asked WHERE request_id % 100 = 0""",
    "category_cases": f"""{LOG}, g AS (SELECT category, query_type, test_case || ':' || count(*) AS t, test_case FROM log GROUP BY category, query_type, test_case)
SELECT category, coalesce(string_agg(t, ',' ORDER BY test_case) FILTER (query_type = 'first'), '') AS first, coalesce(string_agg(t, ',' ORDER BY test_case) FILTER (query_type = 'cached'), '') AS cached FROM g GROUP BY category""",
    "case_filter": f"{LOG}, c AS (SELECT DISTINCT category || '-' || test_case AS name, category, test_case FROM log) SELECT * FROM c WHERE category = 'click' UNION ALL SELECT * FROM c WHERE name = 'view-case_3'",
    "summary_report": f"""SELECT category AS CATEGORY, test_case AS TEST_NAME, query_type AS QUERY_TYPE, run_count AS COUNT, success_count AS SUCCESS, printf('%.2f', mean_ms) AS MEAN_MS, printf('%.2f', std_ms) AS STD_MS, printf('%.2f', min_ms) AS MIN_MS,
  printf('%.2f', max_ms) AS MAX_MS, printf('%.2f', median_ms) AS MEDIAN_MS, printf('%.2f', p95_ms) AS P95_MS, printf('%.2f', avg_distance_m) AS AVG_DIST_M FROM ({_ALL})""",
    "raw_report": f"""{LOG} SELECT category AS CATEGORY, test_case AS TEST_NAME, query_type AS QUERY_TYPE, (row_number() OVER (PARTITION BY category, test_case, query_type ORDER BY start_time, request_id))::INTEGER AS RUN, printf('%.2f', latency_ms) AS LATENCY_MS,
  {_flag('success')} AS SUCCESS, {_flag('path_found')} AS PATH_FOUND, printf('%.2f', coalesce(distance_m, 0)) AS DISTANCE_M, 0 AS SEGMENTS, CASE WHEN success THEN '' ELSE 'timeout' END AS ERROR FROM log""",
    "load_report": f"""SELECT 'all' AS TEST_CASE, 8 AS CONCURRENCY, total AS TOTAL_REQS, success_count AS SUCCESSFUL, total - success_count AS FAILED, printf('%.2f', duration_s) AS DURATION_S, printf('%.2f', rps) AS THROUGHPUT_RPS, printf('%.4f', error_rate) AS ERROR_RATE,
  {', '.join(f"printf('%.2f', {c}) AS {c.upper()}" for c in ('mean_ms', 'std_ms', 'min_ms', 'max_ms', 'p50_ms', 'p95_ms', 'p99_ms'))} FROM ({_LOAD})""",
    "timeline_tsv": f"""{LOG} SELECT {_LINE} AS line FROM log UNION ALL SELECT unnest(['# Load Test Timeline', '# URL: none', '#', array_to_string(['REQUEST_ID', 'START_TIME', 'LATENCY_MS', 'SUCCESS', 'ERROR'], chr(9))])""",
    "min_edges": f"{GRAPH} SELECT u, v, min(weight) AS weight FROM attached GROUP BY u, v",
    "strict_attach": f"{GRAPH} SELECT way_id, count(*)::BIGINT AS edges, count(DISTINCT shard_u)::BIGINT AS shards FROM attached GROUP BY way_id",
    "tag_edges": f"{GRAPH} SELECT way_id, seq, u, v, direction, highway, maxspeed, maxspeed_forward, maxspeed_backward, surface, tracktype, service FROM edges",
    "stored_weights": "SELECT c_custkey::BIGINT AS id, CASE WHEN c_custkey % 50 < 2 THEN 0 ELSE greatest(0, round_even(c_acctbal::DOUBLE / 2, 0))::BIGINT END AS weight FROM customer",
    "travel_times": f"SELECT seconds, {TIME.format(m=MINUTES.format(x='seconds'))} AS shown FROM (SELECT DISTINCT o_orderkey::BIGINT * 37 % 20000 AS seconds FROM orders)",
    "world_cells": f"{WORLD} SELECT n, shard_id, {fx.unsigned_sql('shard_id')} AS shard_text, shard_id AS from_path FROM world",
    "shard_tables": f"{GRAPH} SELECT id, x, y, shard_id FROM nodes",
    "bridge_table": f"{GRAPH} SELECT u, v, weight, shard_u, shard_v FROM attached WHERE shard_u <> shard_v",
    "shard_files": f"{GRAPH} {GRAPH_ROWS}",
    "overlay_file": f"""{GRAPH}, {ENDS}, places AS ({PLACES}) SELECT 'bridge' AS kind, u, v, weight, NULL::DOUBLE AS x, NULL::DOUBLE AS y FROM attached WHERE shard_u <> shard_v
UNION ALL SELECT 'shortcut', src, dst, weight, NULL, NULL FROM found UNION ALL SELECT 'node', node_id, NULL, NULL, round(x, 6), round(y, 6) FROM places""",
    "tile_scan": f"""{CUT} SELECT tile, 'node' AS kind, count(*)::BIGINT AS n FROM inside GROUP BY tile
UNION ALL SELECT t.tile, 'way', count(DISTINCT t.way_id)::BIGINT FROM touched t WHERE t.way_id < 200000 GROUP BY t.tile UNION ALL SELECT 'tile_1_0_1_0_2_0_2_0.osm.pbf', 'corrupt', 1""",
    "tile_nodes": f"{CUT} SELECT tile, id, x, y, shard_id FROM inside WHERE own",
    "tile_owned_edges": f"{CUT} SELECT tile, way_id, u, v, direction, shard_u, shard_v FROM cut_edges WHERE NOT no_u AND NOT no_v AND own",
    "tile_counts": f"{CUT} SELECT per.*, coalesce(sample_u, '') AS sample_u, coalesce(sample_v, '') AS sample_v FROM per LEFT JOIN samples USING (tile)",
    "tile_totals": f"{CUT} SELECT name, sum(value)::BIGINT AS total FROM (UNPIVOT (SELECT * EXCLUDE (tile) FROM per) ON tile_nodes, owned_nodes, tile_edges, owned_edges, missing_u, missing_v INTO NAME name VALUE value) GROUP BY name",
    "tile_distributions": f"{CUT} SELECT name, count(*)::BIGINT AS tiles, min(value) AS low, max(value) AS high, sum(value)::BIGINT AS total FROM (UNPIVOT (SELECT tile_nodes, owned_nodes, owned_edges FROM per) ON tile_nodes, owned_nodes, owned_edges INTO NAME name VALUE value) GROUP BY name",
    "grid_tiles": f"""{REGIONS}, g AS (SELECT region, w + i * 0.5::DOUBLE AS lon, s + j * 0.5::DOUBLE AS lat, e, n, j * ceil((e - w) / 0.5::DOUBLE)::BIGINT + i AS tile FROM r, range(0, 50) a(i), range(0, 50) b(j) WHERE i < ceil((e - w) / 0.5::DOUBLE) AND j < ceil((n - s) / 0.5::DOUBLE))
SELECT region, tile::BIGINT AS tile, round(lon - 0.017966::DOUBLE, 6) AS min_lon, round(lat - 0.017966::DOUBLE, 6) AS min_lat, round(least(lon + 0.5::DOUBLE, e) + 0.017966::DOUBLE, 6) AS max_lon, round(least(lat + 0.5::DOUBLE, n) + 0.017966::DOUBLE, 6) AS max_lat FROM g""",
    "tile_children": f"""{REGIONS}, f AS (SELECT *, greatest(2, least(4, ceil(sqrt(greatest(region * 1000, 1) / 100.0::DOUBLE))))::INTEGER AS k FROM r),
c AS (SELECT region, k, child::INTEGER AS child, w + (child % k) * ((e - w) / k) AS a, s + (child // k) * ((n - s) / k) AS b, w + (child % k + 1) * ((e - w) / k) AS c, s + (child // k + 1) * ((n - s) / k) AS d FROM f, range(0, 16) x(child) WHERE child < k * k)
SELECT region, k AS n, child, round(a, 6) AS min_lon, round(b, 6) AS min_lat, round(c, 6) AS max_lon, round(d, 6) AS max_lat, round(greatest(-4, least(9, a - 0.017966::DOUBLE)), 6) AS out_min_lon, round(greatest(50, least(58, b - 0.017966::DOUBLE)), 6) AS out_min_lat,
  round(greatest(-4, least(9, c + 0.017966::DOUBLE)), 6) AS out_max_lon, round(greatest(50, least(58, d + 0.017966::DOUBLE)), 6) AS out_max_lat FROM c""",
    "tile_assign": f"{GRAPH} SELECT id, CASE WHEN y <= 57 AND x <= 21.2::DOUBLE THEN (least(floor((y - 52.0::DOUBLE) / 0.1::DOUBLE), 49) * 4 + least(floor((x - 20.8::DOUBLE) / 0.1::DOUBLE), 3))::BIGINT END AS tile FROM nodes",
    "split_tiles": f"""{GRAPH}, b AS (SELECT min(x) AS a, min(y) AS b, max(x) AS c, max(y) AS d FROM nodes), p AS (SELECT least(floor((y - b) / ((d - b) / 2)), 1) * 2 + least(floor((x - a) / ((c - a) / 2)), 1) AS k FROM nodes, b),
n AS (SELECT k::INTEGER AS k, count(*)::BIGINT AS points FROM p GROUP BY k)
SELECT '0_' || k AS tile, points, round(a + (k % 2) * (c - a) / 2, 6) AS min_lon, round(b + (k // 2) * (d - b) / 2, 6) AS min_lat, round(a + (k % 2 + 1) * (c - a) / 2, 6) AS max_lon, round(b + (k // 2 + 1) * (d - b) / 2, 6) AS max_lat FROM n, b""",
}
