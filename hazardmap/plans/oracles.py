"""SQL of the registered queries, for another engine over the same tables.

Each query is a chain of named steps; with_steps() puts the steps that a query needs before it.
"""

from __future__ import annotations

from ..config import DANGER_MEANING, DANGER_NAMES, ROAD_TYPES, SPEED_KMH, WATER_DEPTH, WATER_LEVELS
from ..sources.fixtures import VIEWS

NOW = "1735000000000"


def _case(key: str, table: dict, other: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items()) + f" ELSE {other} END"


def _pick(key: str, values: tuple[str, ...]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


def _metres(a: str, b: str, c: str, d: str) -> str:
    return f"(2 * 6371000.0 * asin(sqrt(least(1.0, pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2)))))"


_WAIT = f"greatest(0.0, least(({NOW} - greatest(coalesce(nullif(reported_at, 0), {NOW}), least(coalesce(nullif(synced_at, 0), {NOW}), {NOW}))) / 3600000.0, 24.0))"
_PEOPLE = "greatest(coalesce(people_count, 0), 0)"
_DEPTH = f"CAST({_case('water_level', WATER_DEPTH, '0.0')} AS DOUBLE)"
_SEVERITY = (
    "round(CASE WHEN coalesce(injured, 0) <> 0 THEN 3.0 ELSE 0.0 END::DOUBLE + CASE WHEN coalesce(children_elderly, 0) <> 0 THEN 2.0 ELSE 0.0 END::DOUBLE"
    f" + 1.5::DOUBLE * ln(1 + {_PEOPLE}::DOUBLE) + CASE WHEN coalesce(rising, 0) <> 0 THEN 2.0 ELSE 0.0 END::DOUBLE"
    f" + CASE WHEN coalesce(road_passable, '') = 'no' THEN 2.0 ELSE 0.0 END::DOUBLE + {_DEPTH} + {_WAIT}::DOUBLE, 2)"
)
_WHY = (
    "concat_ws('; ', CASE WHEN coalesce(injured, 0) <> 0 THEN 'injured present +3.0' END, CASE WHEN coalesce(children_elderly, 0) <> 0 THEN 'children or elderly +2.0' END,"
    f" CASE WHEN {_PEOPLE} > 0 THEN {_PEOPLE}::VARCHAR || ' people +' || round(1.5::DOUBLE * ln(1 + {_PEOPLE}::DOUBLE), 2)::VARCHAR END,"
    " CASE WHEN coalesce(rising, 0) <> 0 THEN 'water rising +2.0' END, CASE WHEN road_passable = 'no' THEN 'road cut off +2.0' END,"
    f" CASE WHEN {_DEPTH} > 0 THEN water_level || ' deep +' || ({_DEPTH})::VARCHAR END,"
    f" CASE WHEN {_WAIT} > 0.05 THEN 'waiting ' || round({_WAIT}::DOUBLE, 1)::VARCHAR || ' h +' || round({_WAIT}::DOUBLE, 2)::VARCHAR END)"
)


def _weight(now: str = NOW) -> str:
    return (
        f"(CASE WHEN source = 'aerial' THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END * pow(0.5::DOUBLE, greatest(0.0::DOUBLE, ({now} - coalesce(nullif(synced_at, 0), nullif(reported_at, 0), {now}))::DOUBLE / 3600000.0::DOUBLE) / 3.0::DOUBLE)"
        " * CASE WHEN location_confidence IS NULL THEN 1.0::DOUBLE ELSE greatest(0.2::DOUBLE, least(1.0::DOUBLE, location_confidence)) END"
        " * CASE WHEN coalesce(extraction_confidence, 0) = 0 THEN 1.0::DOUBLE ELSE greatest(0.3::DOUBLE, least(1.0::DOUBLE, extraction_confidence)) END)"
    )


def _confidence(rows: str, keys: str = "cluster") -> str:
    return f"""
SELECT {keys}, round(CASE WHEN aerial THEN sure WHEN voters = 1 THEN least(sure, 0.45::DOUBLE) WHEN voters = 2 THEN least(sure, 0.75::DOUBLE) ELSE sure END, 3) AS confidence, voters FROM (
  SELECT {keys}, count(*) AS voters, 1 - product(1 - least(vote, 0.95::DOUBLE)) AS sure, bool_or(aerial) AS aerial FROM (
    SELECT {keys}, voter, max(weight) AS vote, bool_or(aerial) AS aerial FROM {rows} GROUP BY {keys}, voter) GROUP BY {keys})"""


def _level(rows: str, keys: str = "cluster") -> str:
    on = " AND ".join(f"s.{k.strip()} = m.{k.strip()}" for k in keys.split(","))
    picked = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""
SELECT {keys}, CASE WHEN cut THEN greatest(up, 2) ELSE up END AS level FROM (
  SELECT {keys}, CASE WHEN rising THEN least(base + 1, 4) ELSE base END AS up, cut FROM (
    SELECT {picked}, max(s.claim) FILTER (s.s >= 0.8::DOUBLE * m.most) AS base, bool_or(s.rising) AS rising, bool_or(s.cut) AS cut
    FROM (SELECT {keys}, claim, sum(w) AS s, bool_or(rising) AS rising, bool_or(cut) AS cut FROM (
            SELECT {keys}, claim, voter, max(weight) AS w, bool_or(coalesce(rising, 0) <> 0) AS rising, bool_or(coalesce(road_passable, '') = 'no') AS cut FROM {rows} WHERE weight > 0.01 GROUP BY {keys}, claim, voter)
          GROUP BY {keys}, claim) s
    JOIN (SELECT {keys}, max(s) AS most FROM (SELECT {keys}, claim, sum(w) AS s FROM (SELECT {keys}, claim, voter, max(weight) AS w FROM {rows} WHERE weight > 0.01 GROUP BY {keys}, claim, voter) GROUP BY {keys}, claim) GROUP BY {keys}) m
      ON {on} GROUP BY {picked}))"""


_SEGMENT = """
(SELECT sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2)) FROM (
  SELECT ax, ay, dx, dy, CASE WHEN dx * dx + dy * dy = 0 THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM (
    SELECT (alon - z.lon) * k AS ax, (alat - z.lat) * 111320.0::DOUBLE AS ay, (blon - alon) * k AS dx, (blat - alat) * 111320.0::DOUBLE AS dy FROM (SELECT 111320.0::DOUBLE * cos(radians(z.lat)) AS k))))"""


def _distances(name: str, edges: str, goals: str) -> str:
    """A step that finds the least cost from every node to a goal, by relaxation."""
    return f"""{name}(node, cost) USING KEY (node) AS (
  SELECT node, 0.0::DOUBLE FROM {goals}
  UNION
  SELECT e.b, min(d.cost + e.c) FROM {name} d JOIN {edges} e ON e.a = d.node LEFT JOIN recurring.{name} r ON r.node = e.b
  WHERE r.cost IS NULL OR d.cost + e.c < r.cost GROUP BY e.b)"""


def _hop(edges: str, cost: str) -> str:
    """A step with the next node of every node that is no goal: the neighbour with the least cost from here, then the least id."""
    return f"SELECT e.a AS node, arg_min(e.b, {{'c': d.cost + e.c, 'n': e.b}}) AS onward FROM {edges} e JOIN {cost} d ON d.node = e.b WHERE e.a NOT IN (SELECT node FROM goals) GROUP BY e.a"


def _trips(name: str, edges: str) -> str:
    """A step that finds the least cost from every node to each goal of the trips."""
    return f"""{name}(goal, node, cost) USING KEY (goal, node) AS (
  SELECT DISTINCT goal, goal, 0.0::DOUBLE FROM trips
  UNION
  SELECT d.goal, e.b, min(d.cost + e.c) FROM {name} d JOIN {edges} e ON e.a = d.node LEFT JOIN recurring.{name} r ON r.node = e.b AND r.goal = d.goal
  WHERE r.cost IS NULL OR d.cost + e.c < r.cost GROUP BY d.goal, e.b)"""


def _speed(road_type: str) -> str:
    return f"({_case(road_type, SPEED_KMH, '25.0')})::DOUBLE"


_FIELDS = ("people_count", "water_level", "road_passable")
_TOUCHED = {f: f"(changed_csv = '' OR list_contains(string_split(changed_csv, ','), '{f}'))" for f in _FIELDS}
_ANY = " OR ".join(f"({t} AND {f} IS NOT NULL)" for f, t in _TOUCHED.items())

#: Steps in an order in which each may use those before it; text or (name with columns) AS is added by with_steps().
STEPS: dict[str, str] = {
    **VIEWS,
    "located": "SELECT * FROM reports WHERE lat IS NOT NULL AND lon IS NOT NULL",
    "cells": "SELECT id, lat, lon, floor(lat / 0.00185)::BIGINT AS y, floor(lon / 0.0021)::BIGINT AS x FROM located",
    "near": f"""SELECT a.id AS id_a, b.id AS id_b, {_metres('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS metres
FROM (SELECT *, unnest([-1, 0, 1]) AS dy FROM cells) a JOIN (SELECT *, unnest([-1, 0, 1]) AS dx FROM cells) b ON b.y = a.y + a.dy AND b.x - b.dx = a.x WHERE a.id < b.id""",
    "pairs": "SELECT * FROM near WHERE metres <= 150",
    "both_ways": "SELECT id_a AS a, id_b AS b FROM pairs UNION ALL SELECT id_b, id_a FROM pairs",
    "reach": "SELECT id, id AS other FROM located UNION SELECT r.id, s.b FROM reach r JOIN both_ways s ON r.other = s.a",
    "labels": "SELECT id, min(other) AS cluster FROM reach GROUP BY id",
    "placed": f"SELECT r.*, l.cluster, {_weight()} AS weight, {_case('water_level', WATER_LEVELS, '0')} AS claim, coalesce(nullif(device_id, ''), r.id) AS voter, coalesce(source = 'aerial', false) AS aerial FROM located r JOIN labels l ON r.id = l.id",
    "first_confidence": _confidence("placed"),
    "first_level": _level("placed"),
    "backing": "SELECT cluster, claim, count(DISTINCT voter) AS backers FROM placed WHERE weight > 0.01 GROUP BY cluster, claim",
    "sure": """SELECT c.cluster, c.confidence, coalesce(l.level, 0) AS level, coalesce(b.backers, 0) AS majority FROM first_confidence c
LEFT JOIN first_level l ON c.cluster = l.cluster LEFT JOIN backing b ON b.cluster = c.cluster AND b.claim = coalesce(l.level, 0)
JOIN (SELECT cluster, count(*) AS n FROM placed GROUP BY cluster) k ON k.cluster = c.cluster WHERE k.n >= 2 AND c.confidence >= 0.55""",
    "against": """SELECT p.id, p.cluster, p.claim, s.level, s.confidence, s.majority FROM placed p JOIN sure s ON p.cluster = s.cluster LEFT JOIN backing b ON b.cluster = p.cluster AND b.claim = p.claim
WHERE NOT p.aerial AND abs(p.claim - s.level) >= 2 AND coalesce(b.backers, 0) < s.majority""",
    "held": f"""SELECT id AS report_id, {_pick('claim', DANGER_NAMES)} AS claims, {_pick('level', DANGER_NAMES)} AS group_says, confidence AS group_confidence,
'reports ' || {_pick('claim', DANGER_NAMES)} || ', but ' || majority::VARCHAR || ' other devices here agree on ' || {_pick('level', DANGER_NAMES)} AS reason FROM against
UNION ALL SELECT id, NULL, NULL, 0.0::DOUBLE, 'no usable location' FROM reports WHERE lat IS NULL OR lon IS NULL""",
    "kept": "SELECT * FROM placed WHERE id NOT IN (SELECT id FROM against)",
    "last_confidence": _confidence("kept"),
    "last_level": _level("kept"),
    "centre": "SELECT cluster, avg(lat) AS lat, avg(lon) AS lon, count(*) AS n FROM placed GROUP BY cluster",
    "geometry": f"""SELECT c.cluster, any_value(c.lat) AS lat, any_value(c.lon) AS lon, CASE WHEN any_value(c.n) = 1 THEN 150.0::DOUBLE ELSE round(max({_metres('c.lat', 'c.lon', 'p.lat', 'p.lon')}) + 150.0::DOUBLE, 1) END AS radius_m
FROM placed p JOIN centre c ON p.cluster = c.cluster GROUP BY c.cluster""",
    "counts": f"""SELECT cluster, count(*) AS report_count, count(DISTINCT device_id) + max(CASE WHEN device_id IS NULL THEN 1 ELSE 0 END) AS device_count, bool_or(aerial) AS has_aerial, string_agg(id, ',' ORDER BY id) AS report_ids,
greatest(0.0::DOUBLE, ({NOW} - max(coalesce(nullif(synced_at, 0), nullif(reported_at, 0), 0)))::DOUBLE / 3600000.0::DOUBLE) AS age FROM kept GROUP BY cluster""",
    "all_zones": f"""SELECT 'z-' || c.cluster AS cluster_id, g.lat, g.lon, g.radius_m, coalesce(l.level, 0) AS danger, {_pick('coalesce(l.level, 0)', DANGER_NAMES)} AS danger_name, {_pick('coalesce(l.level, 0)', DANGER_MEANING)} AS meaning,
f.confidence, c.report_count, c.device_count, coalesce(h.held_count, 0) AS held_count, c.has_aerial, round(c.age, 2) AS newest_age_hours,
CASE WHEN f.confidence < 0.25 OR coalesce(l.level, 0) = 0 THEN 'ignore' WHEN f.confidence >= 0.55 AND c.age <= 6 THEN 'block' ELSE 'expensive' END AS routing, c.report_ids,
c.report_count::VARCHAR || ' reports from ' || c.device_count::VARCHAR || ' devices, newest ' || round(c.age, 1)::VARCHAR || ' h ago' || CASE WHEN coalesce(h.held_count, 0) > 0 THEN ', ' || h.held_count::VARCHAR || ' held' ELSE '' END AS evidence
FROM counts c JOIN last_confidence f ON f.cluster = c.cluster LEFT JOIN last_level l ON l.cluster = c.cluster JOIN geometry g ON g.cluster = c.cluster LEFT JOIN (SELECT cluster, count(*) AS held_count FROM against GROUP BY cluster) h ON h.cluster = c.cluster""",
    "zones": "SELECT * FROM all_zones WHERE confidence >= 0.25 AND danger > 0",
    "lines": f"""SELECT e.a, e.b, e.road_type, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, {_metres('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS length_m
FROM road_edges e JOIN road_nodes a ON e.a = a.node_id JOIN road_nodes b ON e.b = b.node_id""",
    "hits": f"""SELECT a, b, z.cluster_id, z.routing, z.danger, z.confidence FROM lines l JOIN zones z
ON greatest(alat, blat) >= z.lat - z.radius_m / 110000.0 AND least(alat, blat) <= z.lat + z.radius_m / 110000.0 AND greatest(alon, blon) >= z.lon - z.radius_m / 90000.0 AND least(alon, blon) <= z.lon + z.radius_m / 90000.0
WHERE {_SEGMENT} <= z.radius_m""",
    "effects": """SELECT a, b, routing AS effect, CASE WHEN routing = 'expensive' THEN 5.0::DOUBLE END AS multiplier, cluster_id FROM (
SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY CASE WHEN routing = 'block' THEN 0 ELSE 1 END, danger DESC, confidence DESC, cluster_id) AS r FROM hits) WHERE r = 1""",
    "usable": "SELECT id, name, lat, lon, capacity, occupied FROM safe_zones WHERE coalesce(status, 'open') = 'open' AND coalesce(occupied, 0) < coalesce(capacity, 0)",
    "snapped": f"SELECT s.id, arg_min(n.node_id, {{'m': {_metres('s.lat', 's.lon', 'n.lat', 'n.lon')}, 'n': n.node_id}}) AS node_id FROM usable s, road_nodes n GROUP BY s.id",
    "goals": "SELECT node_id AS node, min(id) AS shelter_id FROM snapped GROUP BY node_id",
    "aware": f"SELECT l.a, l.b, length_m / ({_speed('road_type')} * 1000.0::DOUBLE / 3600.0::DOUBLE) * coalesce(multiplier, 1.0::DOUBLE) AS c, e.effect FROM lines l LEFT JOIN effects e ON l.a = e.a AND l.b = e.b WHERE coalesce(e.effect, '') <> 'block'",
    "aware_two": "SELECT a, b, c FROM aware UNION ALL SELECT b, a, c FROM aware",
    "sure_two": "SELECT a, b, c FROM aware WHERE effect IS NULL UNION ALL SELECT b, a, c FROM aware WHERE effect IS NULL",
    "walk_two": "SELECT l.a, l.b, length_m / (4.0::DOUBLE * 1000.0::DOUBLE / 3600.0::DOUBLE) AS c FROM lines l LEFT JOIN effects e ON l.a = e.a AND l.b = e.b WHERE e.effect IS NULL UNION ALL SELECT l.b, l.a, length_m / (4.0::DOUBLE * 1000.0::DOUBLE / 3600.0::DOUBLE) FROM lines l LEFT JOIN effects e ON l.a = e.a AND l.b = e.b WHERE e.effect IS NULL",
    "careless_two": f"SELECT a, b, length_m / ({_speed('road_type')} * 1000.0::DOUBLE / 3600.0::DOUBLE) AS c FROM lines UNION ALL SELECT b, a, length_m / ({_speed('road_type')} * 1000.0::DOUBLE / 3600.0::DOUBLE) FROM lines",
    "aware_cost": _distances("aware_cost", "aware_two", "goals"),
    "sure_cost": _distances("sure_cost", "sure_two", "goals"),
    "walk_cost": _distances("walk_cost", "walk_two", "goals"),
    "careless_cost": _distances("careless_cost", "careless_two", "goals"),
    "careless_hop": _hop("careless_two", "careless_cost"),
    "aware_hop": _hop("aware_two", "aware_cost"),
    "careless_walk": "SELECT node AS start, node FROM careless_cost UNION ALL SELECT w.start, h.onward FROM careless_walk w JOIN careless_hop h ON h.node = w.node",
    "aware_walk": "SELECT node AS start, node FROM aware_cost UNION ALL SELECT w.start, h.onward FROM aware_walk w JOIN aware_hop h ON h.node = w.node",
    "careless_steps": "SELECT w.start, least(h.node, h.onward) AS a, greatest(h.node, h.onward) AS b FROM careless_walk w JOIN careless_hop h ON h.node = w.node",
    "aware_steps": "SELECT w.start, least(h.node, h.onward) AS a, greatest(h.node, h.onward) AS b FROM aware_walk w JOIN aware_hop h ON h.node = w.node",
    "careless_length": "SELECT s.start, sum(l.length_m) AS metres FROM careless_steps s JOIN lines l ON s.a = l.a AND s.b = l.b GROUP BY s.start",
    "aware_length": "SELECT s.start, sum(l.length_m) AS metres FROM aware_steps s JOIN lines l ON s.a = l.a AND s.b = l.b GROUP BY s.start",
    "aware_risk": "SELECT start, count(*) AS n, max(newest_age_hours) AS oldest FROM (SELECT DISTINCT s.start, e.cluster_id FROM aware_steps s JOIN effects e ON s.a = e.a AND s.b = e.b WHERE e.effect = 'expensive') r JOIN zones z ON z.cluster_id = r.cluster_id GROUP BY start",
    "arrival": "SELECT w.start, g.shelter_id FROM aware_walk w JOIN goals g ON g.node = w.node",
    "detour_starts": "SELECT DISTINCT s.start FROM careless_steps s JOIN effects e ON s.a = e.a AND s.b = e.b WHERE e.effect = 'block' AND s.start IN (SELECT a FROM effects WHERE effect = 'block' UNION SELECT b FROM effects WHERE effect = 'block')",
    "trips": "SELECT node_id AS start, least(ceil(node_id::BIGINT / 500.0)::BIGINT * 500, (SELECT max(node_id::BIGINT) FROM road_nodes))::VARCHAR AS goal FROM road_nodes",
    "aware_trip": _trips("aware_trip", "aware_two"),
    "careless_trip": _trips("careless_trip", "careless_two"),
    "entered": "SELECT DISTINCT a, b, routing FROM hits WHERE routing <> 'ignore'",
    "crossed": "SELECT 'naive' AS scenario, s.start, e.routing, count(*) AS steps FROM careless_steps s JOIN entered e ON s.a = e.a AND s.b = e.b GROUP BY s.start, e.routing UNION ALL SELECT 'aware', s.start, e.routing, count(*) FROM aware_steps s JOIN entered e ON s.a = e.a AND s.b = e.b GROUP BY s.start, e.routing",
    "numbered": f"SELECT *, row_number() OVER (PARTITION BY id ORDER BY arrival_seq) = 1 AS is_first, ({_ANY}) AS touches FROM edit_log",
    "candidates": "SELECT *, max(CASE WHEN is_first OR touches THEN counter END) OVER (PARTITION BY id ORDER BY arrival_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM numbered",
    "judged": "SELECT *, CASE WHEN is_first THEN 'created' WHEN touches AND counter > before THEN 'merged' ELSE 'ignored' END AS outcome FROM candidates",
    "merged": "SELECT id, "
    + ", ".join(f"arg_max_null({f}, arrival_seq) FILTER (outcome = 'created') AS {f}" for f in ("device_id", "phone_time"))
    + ", "
    + ", ".join(f"arg_max_null({f}, arrival_seq) FILTER (outcome = 'created' OR (outcome = 'merged' AND {t} AND {f} IS NOT NULL)) AS {f}" for f, t in _TOUCHED.items())
    + ", arg_max(counter, arrival_seq) FILTER (outcome <> 'ignored') AS counter, arg_max(phone_time, arrival_seq) FILTER (outcome = 'created') AS reported_at, arg_max(arrival_ms, arrival_seq) FILTER (outcome <> 'ignored') AS synced_at,"
    " arg_max(arrival_ms, arrival_seq) FILTER (outcome <> 'ignored') AS updated_at FROM judged GROUP BY id",
    "mapped": f"SELECT *, {_case('highway', ROAD_TYPES, 'NULL')} AS road_type FROM way_members",
    "inside": f"SELECT z.cluster_id, i.incident_id FROM zones z, incidents i WHERE {_metres('z.lat', 'z.lon', 'i.lat', 'i.lon')} <= z.radius_m + 50",
    "seeds": r"SELECT (regexp_extract(cluster_id, '(\d+)$', 1)::BIGINT) % 7 AS seed, held_count, report_count, CASE WHEN routing <> 'ignore' THEN 1 ELSE 0 END AS shown FROM all_zones",
}
_RECURSIVE_KEYED = ("aware_cost", "sure_cost", "walk_cost", "careless_cost", "aware_trip", "careless_trip")


def with_steps(sql: str) -> str:
    """The query with the steps that it uses, directly or through others."""
    import re

    order, needed, todo = list(STEPS), set(), [sql]
    while todo:
        text = todo.pop()
        for name in order:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(STEPS[name])
    steps = [STEPS[n] if n in _RECURSIVE_KEYED else f"{n} AS ({STEPS[n].strip()})" for n in order if n in needed]
    return ("WITH RECURSIVE " + ",\n".join(steps) + "\n" if steps else "") + sql


def _sweep() -> str:
    return """SELECT m.radius_m, m.merges, s.splits FROM
(SELECT radius_m, count(*) FILTER (n > 1) AS merges FROM (SELECT radius_m, cluster, count(DISTINCT incident) AS n FROM swept GROUP BY radius_m, cluster) GROUP BY radius_m) m
JOIN (SELECT radius_m, count(*) FILTER (n > 1) AS splits FROM (SELECT radius_m, incident, count(DISTINCT cluster) AS n FROM swept GROUP BY radius_m, incident) GROUP BY radius_m) s ON m.radius_m = s.radius_m"""


STEPS["radii"] = "SELECT unnest([75.0, 100.0, 150.0, 200.0])::DOUBLE AS radius_m"
STEPS["radius_links"] = "SELECT radius_m, id_a AS a, id_b AS b FROM near, radii WHERE metres <= radius_m UNION ALL SELECT radius_m, id_b, id_a FROM near, radii WHERE metres <= radius_m"
STEPS["radius_reach"] = "SELECT radius_m, id, id AS other FROM located, radii UNION SELECT r.radius_m, r.id, l.b FROM radius_reach r JOIN radius_links l ON r.other = l.a AND r.radius_m = l.radius_m"
STEPS["swept"] = "SELECT radius_m, id, min(other) AS cluster, floor(substr(id, 2)::BIGINT / 8) AS incident FROM radius_reach GROUP BY radius_m, id"
STEPS["instants"] = f"SELECT h::DOUBLE AS hours, ({NOW} + h * 3600000)::BIGINT AS now_ms FROM (SELECT unnest([0, 3, 6, 12]) AS h)"
STEPS["later"] = f"SELECT p.* EXCLUDE (weight), i.hours, {_weight('i.now_ms')} AS weight FROM placed p, instants i"
STEPS["later_confidence"] = _confidence("later", "cluster, hours")
STEPS["later_level"] = _level("later", "cluster, hours")

_Q = {
    "severity": f"SELECT id, {_SEVERITY} AS severity, round({_WAIT}::DOUBLE, 6) AS hours FROM reports",
    "why": f"SELECT id, {_WHY} AS why FROM reports",
    "triage": f"SELECT id, {_SEVERITY} AS severity, reported_at FROM reports ORDER BY severity DESC, reported_at, id",
    "upload_json": "SELECT id, device_id, counter, phone_time, people_count, water_level, road_passable, changed_csv FROM edit_log",
    "upload_quarantine": """SELECT '{"reports": [{"id": "' || id AS value FROM edit_log WHERE arrival_seq % 10 = 0 UNION ALL SELECT 'no upload ' || id FROM edit_log WHERE arrival_seq % 10 = 0""",
    "osm_json": """SELECT highway, count(DISTINCT way_id) AS ways, count(*) AS members, (SELECT count(*) FROM road_nodes) AS nodes, (SELECT round(sum(lat), 6) FROM road_nodes) AS lats,
(SELECT count(*) FROM road_nodes WHERE CAST(node_id AS INTEGER) % 100 = 0) AS bad_lines FROM way_members GROUP BY highway""",
    "report_lookup": f"SELECT id, device_id, reported_at FROM reports WHERE id IN (SELECT id FROM (SELECT id FROM reports ORDER BY {_SEVERITY} DESC, reported_at, id LIMIT 100))",
    "map_instants": "SELECT c.cluster, c.hours, c.confidence, coalesce(l.level, 0) AS danger FROM later_confidence c LEFT JOIN later_level l ON c.cluster = l.cluster AND c.hours = l.hours WHERE c.hours IN (0.0, 3.0)",
    "triage_top": f"SELECT id, {_SEVERITY} AS severity, reported_at FROM reports ORDER BY severity DESC, reported_at, id LIMIT 100",
    "weights": f"SELECT id, round({_weight()}, 9) AS weight FROM reports",
    "held_unlocated": "SELECT id AS report_id, 'no usable location' AS reason FROM reports WHERE lat IS NULL OR lon IS NULL",
    "merge_reports": "SELECT * FROM merged",
    "stream_merge": "SELECT * FROM merged",
    "stream_delta": "SELECT id, counter, updated_at FROM merged WHERE updated_at > 1735000500000",
    "merge_outcomes": "SELECT count(*) FILTER (outcome = 'created') AS created, count(*) FILTER (outcome = 'merged') AS merged, count(*) FILTER (outcome = 'ignored') AS ignored FROM judged",
    "edit_outcomes": "SELECT arrival_seq, id, outcome FROM judged",
    "delta_sync": "SELECT id, counter, updated_at FROM merged WHERE updated_at > 1735000500000 ORDER BY updated_at, id",
    "delta_cursor": "SELECT coalesce(max(updated_at), 1735000500000) AS cursor FROM merged WHERE updated_at > 1735000500000",
    "json_fields": """SELECT id, CASE WHEN json_valid(p) THEN json_array_length(p)::INT ELSE -1 END AS n_photos, CASE WHEN json_valid(p) THEN json_extract_string(p, '$[0]') END AS first_photo, json_extract(g, '$[1][0]')::DOUBLE AS second_lat
FROM (SELECT id, CASE WHEN substr(id, 2)::BIGINT % 5 = 0 THEN 'not json' ELSE '["' || device_id || '","' || source || '"]' END AS p, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN '[[26.0,92.0],[26.5,92.5]]' END AS g FROM reports)""",
    "near_pairs": "SELECT id_a, id_b, round(metres, 3) AS metres FROM pairs",
    "clusters": "SELECT id, cluster FROM labels UNION ALL SELECT id, id FROM reports WHERE lat IS NULL OR lon IS NULL",
    "confidence": "SELECT * FROM first_confidence",
    "danger_level": "SELECT * FROM first_level",
    "held_reports": "SELECT * FROM held",
    "zone_geometry": "SELECT cluster, round(lat, 9) AS lat, round(lon, 9) AS lon, radius_m FROM geometry",
    "zone_routing": "SELECT cluster_id, danger, confidence, newest_age_hours, routing FROM all_zones",
    "zone_members": "SELECT 'z-' || cluster AS cluster_id, id AS report_id FROM kept",
    "danger_zones": "SELECT * REPLACE (round(lat, 9) AS lat, round(lon, 9) AS lon) FROM zones ORDER BY danger DESC, confidence DESC, cluster_id",
    "live_map": "SELECT * EXCLUDE (report_ids) REPLACE (round(lat, 9) AS lat, round(lon, 9) AS lon) FROM zones ORDER BY danger DESC, confidence DESC, cluster_id",
    "map_stats": """SELECT (SELECT count(*) FROM reports) AS reports, (SELECT count(DISTINCT cluster) FROM labels) + (SELECT count(*) FROM reports WHERE lat IS NULL OR lon IS NULL) AS clusters, count(*) AS zones_drawn,
count(*) FILTER (routing = 'block') AS blocked, count(*) FILTER (routing = 'expensive') AS expensive, (SELECT count(*) FROM held) AS held_for_review FROM zones""",
    "decay_curve": "SELECT c.cluster, c.hours, c.confidence, coalesce(l.level, 0) AS danger FROM later_confidence c LEFT JOIN later_level l ON c.cluster = l.cluster AND c.hours = l.hours",
    "osm_counts": "SELECT (SELECT count(*) FROM road_nodes) AS nodes, count(*) AS ways, sum(greatest(n - 1, 0))::BIGINT AS segments FROM (SELECT way_id, count(*) AS n FROM way_members GROUP BY way_id)",
    "osm_extract": """SELECT w.highway, count(DISTINCT w.way_id) AS ways, count(*) AS members, any_value(k.nodes) AS nodes, any_value(k.least) AS least, any_value(k.most) AS most FROM (
SELECT * FROM way_members WHERE way_id IN (SELECT way_id FROM way_members m JOIN road_nodes n ON m.node_id = n.node_id WHERE lat BETWEEN 26.0 AND 26.02 AND lon BETWEEN 92.0 AND 92.06 AND highway IN ('motorway', 'primary', 'tertiary', 'track'))) w,
(SELECT count(*) AS nodes, min(node_id) AS least, max(node_id) AS most FROM road_nodes WHERE node_id IN (SELECT m.node_id FROM way_members m WHERE m.way_id IN (SELECT way_id FROM way_members m JOIN road_nodes n ON m.node_id = n.node_id
WHERE lat BETWEEN 26.0 AND 26.02 AND lon BETWEEN 92.0 AND 92.06 AND highway IN ('motorway', 'primary', 'tertiary', 'track')))) k GROUP BY w.highway""",
    "fit_bbox": """SELECT arg_min(step, step) AS step, round(arg_min(half_km, step), 6) AS half_km, arg_min(nodes, step) AS nodes FROM (
SELECT step, half_km, (SELECT count(*) FROM road_nodes WHERE lat BETWEEN 26.02 - dlat AND 26.02 + dlat AND lon BETWEEN 92.05 - dlat / cos(radians(26.02)) AND 92.05 + dlat / cos(radians(26.02))) AS nodes FROM (
SELECT step, 13.0 * pow(0.8, step) AS half_km, 13.0 * pow(0.8, step) * 1000 / 111320.0 AS dlat FROM (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS step))) WHERE nodes <= 300 OR step = 7""",
    "road_types": f"SELECT highway, count(DISTINCT way_id) AS ways, {_case('highway', ROAD_TYPES, 'NULL')} AS road_type FROM way_members GROUP BY highway",
    "road_quality": """SELECT (SELECT count(*) FROM (SELECT way_id, road_type FROM mapped GROUP BY way_id, road_type) WHERE road_type IS NULL) AS unmapped_ways,
(SELECT count(*) FROM way_members WHERE node_id NOT IN (SELECT node_id FROM road_nodes WHERE node_id::INT % 10 <> 3)) AS members_without_place""",
    "build_edges": f"""SELECT a, b, round(m, 3) AS length_m, road_type FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY way_id DESC, pos DESC) AS r FROM (
SELECT least(u, v) AS a, greatest(u, v) AS b, way_id, pos, road_type, {_metres('x.lat', 'x.lon', 'y.lat', 'y.lon')} AS m FROM (
SELECT way_id, road_type, pos, node_id AS u, lead(node_id) OVER (PARTITION BY way_id ORDER BY pos) AS v FROM mapped WHERE road_type IS NOT NULL) s
JOIN road_nodes x ON s.u = x.node_id JOIN road_nodes y ON s.v = y.node_id WHERE x.node_id::INT % 10 <> 3 AND y.node_id::INT % 10 <> 3)) WHERE r = 1""",
    "edge_lengths": "SELECT a, b, round(length_m, 3) AS length_m FROM lines",
    "travel_seconds": f"SELECT a, b, round(length_m / ({_speed('road_type')} * 1000.0::DOUBLE / 3600.0::DOUBLE), 3) AS drive_s, round(length_m / (4.0::DOUBLE * 1000.0::DOUBLE / 3600.0::DOUBLE), 3) AS walk_s FROM lines",
    "nearest_node": f"SELECT r.id, round(min({_metres('r.lat', 'r.lon', 'n.lat', 'n.lon')}), 2) AS metres FROM located r, road_nodes n GROUP BY r.id",
    "open_shelters": "SELECT id, name, capacity, occupied FROM usable",
    "shelter_nodes": "SELECT node AS node_id, shelter_id FROM goals",
    "safe_zone_upsert": """SELECT id, capacity, o AS occupied, CASE WHEN o >= capacity THEN 'full' ELSE status END AS status FROM (SELECT *, (CASE WHEN length(id) % 2 = 1 THEN occupied + 20 ELSE occupied END)::INT AS o FROM safe_zones)""",
    "edge_effects": "SELECT * FROM effects",
    "zones_on_roads": "SELECT DISTINCT cluster_id, routing FROM hits",
    "roads_export": "SELECT DISTINCT a, b FROM road_edges",
    "roads_blocked": "SELECT a, b, cluster_id FROM effects WHERE effect = 'block'",
    "quality_gate": """SELECT *, confirmed > 0 AND on_roads * 2 >= confirmed AS passed FROM (SELECT (SELECT count(*) FROM zones WHERE routing = 'block') AS confirmed, (SELECT count(DISTINCT cluster_id) FROM hits WHERE routing = 'block') AS on_roads,
(SELECT count(*) FROM effects WHERE effect = 'block') AS blocked, (SELECT count(*) FROM effects WHERE effect = 'expensive') AS expensive, (SELECT count(*) FROM road_edges) AS roads)""",
    "evacuation": "SELECT n.node_id, d.cost IS NOT NULL AS found, round(d.cost, 3) AS seconds FROM road_nodes n LEFT JOIN aware_cost d ON n.node_id = d.node",
    "evacuation_strict": "SELECT n.node_id, d.cost IS NOT NULL AS found, round(d.cost, 3) AS seconds FROM road_nodes n LEFT JOIN walk_cost d ON n.node_id = d.node",
    "trapped_nodes": "SELECT n.node_id, CASE WHEN d.cost IS NULL THEN 'trapped' ELSE 'uncertain only' END AS state FROM road_nodes n LEFT JOIN aware_cost d ON n.node_id = d.node LEFT JOIN sure_cost s ON n.node_id = s.node WHERE s.cost IS NULL",
    "routes_to_safety": f"""SELECT o.id, o.snapped_m, d.cost IS NOT NULL AS found, v.shelter_id, round(d.cost, 1) AS travel_seconds, CASE WHEN d.cost IS NOT NULL THEN round(coalesce(round(l.metres, 1), 0.0::DOUBLE), 0) END AS distance_m, coalesce(k.n, 0) AS uncertain_zones,
CASE WHEN d.cost IS NOT NULL THEN CASE WHEN k.n > 0 THEN 'uncertain' ELSE 'clear' END END AS confidence,
CASE WHEN d.cost IS NOT NULL THEN CASE WHEN k.n > 0 THEN 'crosses ' || k.n::VARCHAR || ' unconfirmed zone(s); newest supporting report ' || k.oldest::VARCHAR || ' h old' ELSE 'avoids every confirmed danger zone' END END AS evidence,
CASE WHEN d.cost IS NULL THEN 'every route out crosses a confirmed danger zone' END AS reason FROM (
SELECT r.id, arg_min(n.node_id, {{'m': {_metres('r.lat', 'r.lon', 'n.lat', 'n.lon')}, 'n': n.node_id}}) AS node, round(min({_metres('r.lat', 'r.lon', 'n.lat', 'n.lon')}), 1) AS snapped_m FROM located r, road_nodes n GROUP BY r.id) o
LEFT JOIN aware_cost d ON o.node = d.node LEFT JOIN arrival v ON v.start = o.node LEFT JOIN aware_length l ON l.start = o.node LEFT JOIN aware_risk k ON k.start = o.node""",
    "forced_detours": """SELECT s.start, round(n.cost, 3) AS naive_seconds, round(w.cost, 3) AS aware_seconds, round(coalesce(x.metres, 0.0::DOUBLE), 1) AS naive_distance_m, CASE WHEN w.cost IS NOT NULL THEN round(coalesce(y.metres, 0.0::DOUBLE), 1) END AS aware_distance_m
FROM detour_starts s JOIN careless_cost n ON n.node = s.start LEFT JOIN aware_cost w ON w.node = s.start LEFT JOIN careless_length x ON x.start = s.start LEFT JOIN aware_length y ON y.start = s.start""",
    "route_crossings": "SELECT "
    + ", ".join(f"count(*) FILTER (scenario = '{s}' AND routing = '{r}') AS {s}_{r}_routes, coalesce(sum(steps) FILTER (scenario = '{s}' AND routing = '{r}'), 0)::BIGINT AS {s}_{r}_steps" for s in ("naive", "aware") for r in ("block", "expensive"))
    + " FROM crossed",
    "roads_nodes": "SELECT node_id, round(lat, 9) AS lat, round(lon, 9) AS lon FROM road_nodes",
    "roads_penalised": "SELECT a, b, multiplier, cluster_id FROM effects WHERE effect = 'expensive'",
    "report_by_id": f"""SELECT q.id, r.id IS NOT NULL AS found, CASE WHEN r.id IS NOT NULL THEN {_SEVERITY} END AS severity, CASE WHEN r.id IS NOT NULL THEN {_WHY} END AS because
FROM (SELECT 'r' || event_id::VARCHAR AS id FROM events WHERE event_id % 20 = 0 UNION ALL SELECT 'none' || event_id::VARCHAR FROM events WHERE event_id % 20 = 0) q LEFT JOIN reports r ON r.id = q.id""",
    "route_pairs": "SELECT s.start || '>' || s.goal AS query_id, d.cost IS NOT NULL AS found, round(d.cost, 1) AS travel_seconds FROM trips s LEFT JOIN aware_trip d ON s.start = d.node AND s.goal = d.goal",
    "detour_cost": """SELECT count(*) AS routes, round(avg(100.0 * (round(a.cost, 1) - round(n.cost, 1)) / round(n.cost, 1)), 1) AS extra_percent
FROM trips s JOIN aware_trip a ON s.start = a.node AND s.goal = a.goal JOIN careless_trip n ON s.start = n.node AND s.goal = n.goal WHERE round(n.cost, 1) > 0""",
    "score_geometry": """SELECT (SELECT count(*) FROM (SELECT incident_id FROM inside GROUP BY incident_id HAVING count(*) = 1)) AS recovered, (SELECT count(*) FROM incidents) AS total,
(SELECT count(*) FROM (SELECT cluster_id FROM inside GROUP BY cluster_id HAVING count(*) > 1)) AS merges, (SELECT count(*) FROM (SELECT incident_id FROM inside GROUP BY incident_id HAVING count(*) > 1)) AS splits, (SELECT count(*) FROM held) AS held""",
    "score_membership": """SELECT (SELECT count(*) FROM (SELECT cluster FROM m GROUP BY cluster HAVING count(DISTINCT incident) > 1)) AS merges, (SELECT count(*) FROM (SELECT incident FROM m GROUP BY incident HAVING count(DISTINCT cluster) > 1)) AS splits,
(SELECT count(*) FROM reports WHERE id NOT IN (SELECT id FROM m)) AS unresolved FROM (SELECT 1) one""",
    "radius_sweep": _sweep(),
    "seed_stats": """SELECT metric, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, round(coalesce(stddev_samp(value), 0), 6) AS stdev, count(*) FILTER (value > 0) AS affected, round(avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END::DOUBLE), 6) AS affected_share FROM (
SELECT 'held' AS metric, sum(held_count)::DOUBLE AS value FROM seeds GROUP BY seed UNION ALL SELECT 'shown', sum(shown)::DOUBLE FROM seeds GROUP BY seed) GROUP BY metric""",
    "accuracy_sweep": """SELECT accuracy, round(recovery, 9) AS recovery, round(held_rate, 9) AS held_rate, collapse, high AND sum(CASE WHEN high THEN 1 ELSE 0 END) OVER (ORDER BY accuracy DESC) = 1 AS spike FROM (
SELECT *, held_rate >= 2.0 * base AND NOT collapse AS high FROM (
SELECT *, low AND sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (ORDER BY accuracy DESC) = 1 AS collapse FROM (
SELECT accuracy, recovery, held_rate, recovery < 0.9 AS low, first_value(held_rate) OVER (ORDER BY accuracy DESC) AS base FROM (
SELECT ((seed + 3) / 10.0)::DOUBLE AS accuracy, sum(shown)::DOUBLE / count(*) AS recovery, sum(held_count)::DOUBLE / sum(report_count) AS held_rate FROM seeds GROUP BY seed))))""",
    "road_components": """SELECT component, count(*) AS nodes FROM (SELECT n.node_id, coalesce(min(r.other), n.node_id) AS component FROM road_nodes n LEFT JOIN road_reach r ON n.node_id = r.id GROUP BY n.node_id) GROUP BY component""",
}
STEPS["m"] = "SELECT k.id, k.cluster, floor(substr(k.id, 2)::BIGINT / 8) AS incident FROM kept k JOIN zones z ON z.cluster_id = 'z-' || k.cluster"
STEPS["road_links"] = "SELECT a, b FROM road_edges WHERE a::INT % 50 <> 25 AND b::INT % 50 <> 25 UNION ALL SELECT b, a FROM road_edges WHERE a::INT % 50 <> 25 AND b::INT % 50 <> 25"
STEPS["road_reach"] = """SELECT a AS id, a AS other FROM road_links UNION SELECT r.id, l.b FROM road_reach r JOIN road_links l ON r.other = l.a"""

ORACLES: dict[str, str] = {k: with_steps(v) for k, v in _Q.items()}
