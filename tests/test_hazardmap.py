"""Scenes with known answers, differential tests and the SQL of the registered queries."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hazardmap.config import Tuning
from hazardmap.functions import columns as c
from hazardmap.operators import cluster, components, danger, effects, merge, nearest, paths, roads
from hazardmap.sources import fixtures, tables
from hazardmap.streaming import ingest

NOW = 1_735_000_000_000
T = Tuning()
COLUMNS = "id string, device_id string, source string, lat double, lon double, location_confidence double, people_count int, injured int, children_elderly int, water_level string, rising int, road_passable string, extraction_confidence double, reported_at bigint, synced_at bigint"


def report(i, device, north=0.0, level="waist", minutes=10, source="volunteer", rising=0, road="unknown", lat=26.25, lon=92.34):
    at = NOW - minutes * 60_000
    where = (lat + north / 111_194.9, lon) if lat is not None else (None, None)
    return (i, device, source, *where, 1.0, 5, 0, 0, level, rising, road, 0.0, at, at)


def scene(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def test_four_places(spark):
    rows = [report(f"a{i}", f"da{i}", 40 * i, rising=1, road="no", minutes=10 + 5 * i) for i in range(4)]
    rows += [report("b0", "db", 3000, "knee", 20)]
    rows += [report(f"c{i}", f"dc{i}", 6000 + 20 * i, "knee", 240 + 60 * i) for i in range(3)]
    rows += [report(f"d{i}", "dd", 9000, "waist", 15) for i in range(5)]
    zones = {r["cluster_id"]: r for r in danger.all_zones(danger.placed(scene(spark, rows), T), T).collect()}
    assert len(zones) == 4
    a, b, d = zones["z-a0"], zones["z-b0"], zones["z-d0"]
    assert a["confidence"] > 0.8 and a["routing"] == "block" and a["danger"] == 4
    assert b["confidence"] == 0.45 and b["routing"] == "expensive" and b["radius_m"] == 150.0
    assert d["report_count"] == 5 and d["device_count"] == 1 and d["confidence"] == 0.45
    assert zones["z-c0"]["confidence"] < 0.55


def test_contradiction_is_held(spark):
    rows = [report(f"w{i}", f"d{i}", 10 * i, road="no", minutes=30 + 10 * i) for i in range(4)] + [report("clear", "dx", 15, None, 5, road="yes")]
    placed = danger.placed(scene(spark, rows), T)
    held = danger.held_reports(placed, scene(spark, rows), T).collect()
    assert [r["report_id"] for r in held] == ["clear"]
    assert held[0]["reason"] == "reports safe, but 4 other devices here agree on severe"
    zone = danger.all_zones(placed, T).first()
    assert zone["routing"] == "block" and zone["danger"] == 3 and zone["held_count"] == 1 and zone["report_count"] == 4


def test_aerial_counts_alone(spark):
    rows = [report("k1", "d1", 0, "knee", 90), report("k2", "d2", 10, "knee", 110), report("air", "drone", 5, "waist", 5, source="aerial")]
    zone = danger.all_zones(danger.placed(scene(spark, rows), T), T).first()
    assert zone["danger"] >= 3 and zone["has_aerial"] and zone["confidence"] > 0.55


def test_confidence_falls_with_silence(spark):
    rows = [report(f"a{i}", f"d{i}", 10 * i) for i in range(4)]
    curve = danger.decay_curve(scene(spark, rows), [0.0, 3.0, 6.0, 12.0], T).orderBy("hours").collect()
    got = [r["confidence"] for r in curve]
    assert got == sorted(got, reverse=True) and got[0] > got[-1]


def test_unlocated_is_held_and_empty_map(spark):
    rows = [report("n", "d", lat=None)]
    held = danger.held_reports(danger.placed(scene(spark, rows), T), scene(spark, rows), T).first()
    assert held["reason"] == "no usable location"
    assert danger.danger_zones(scene(spark, []), T).count() == 0
    stats = danger.map_stats(scene(spark, rows), T).first()
    assert (stats["reports"], stats["clusters"], stats["zones_drawn"], stats["held_for_review"]) == (1, 1, 0, 1)


def test_severity_of_a_broken_clock(spark):
    r = scene(spark, [report("x", "d")]).withColumn("reported_at", F.lit(0)).withColumn("people_count", F.lit(0))
    assert r.select(c.severity(T).alias("s")).first()["s"] < 20
    assert c is not None and r.select(c.reasons(T).alias("w")).first()["w"][0] == "waist deep +2.0"


LOG = "id string, device_id string, counter long, arrival_seq long, arrival_ms long, phone_time long, a string, b int, changed array<string>"


def fold(log):
    rows, outcomes = {}, []
    for i, dev, counter, _, ms, phone, a, b, changed in sorted(log, key=lambda r: r[3]):
        new = {"a": a, "b": b}
        if i not in rows:
            rows[i] = {"device_id": dev, "phone_time": phone, "counter": counter, "updated_at": ms, **new}
            outcomes.append("created")
            continue
        edit = {f: v for f, v in new.items() if (not changed or f in changed) and v is not None}
        if counter <= rows[i]["counter"] or not edit:
            outcomes.append("ignored")
            continue
        rows[i] |= edit | {"counter": counter, "updated_at": ms}
        outcomes.append("merged")
    return rows, outcomes


def random_log(seed, n=400):
    rng = random.Random(seed)
    pick = lambda *x: rng.choice(x)
    return [(f"r{rng.randrange(40)}", f"d{rng.randrange(3)}", rng.randrange(6), s, NOW + s, s * 10, pick(None, "x", "y"), pick(None, 1, 2), pick(None, [], ["a"], ["b"], ["a", "b"], ["zz"])) for s in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_merge_equals_a_fold(spark, seed):
    log = random_log(seed)
    frame = spark.createDataFrame(log, LOG).repartition(5)
    rows, outcomes = fold(log)
    got = [r["outcome"] for r in merge.judge_edits(frame, ["a", "b"]).orderBy("arrival_seq").collect()]
    assert got == outcomes
    for r in merge.merge_reports(frame, ["a", "b"]).collect():
        assert {k: r[k] for k in ("device_id", "phone_time", "counter", "updated_at", "a", "b")} == rows[r["id"]]


def test_stream_equals_batch(spark, tmp_path):
    log = random_log(3)
    source = str(tmp_path / "in")
    for k in range(4):
        spark.createDataFrame(log[k * 100 : k * 100 + 100], LOG).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(LOG).parquet(source)
        ingest.start_merge(stream, str(tmp_path / "out"), str(tmp_path / "check"), ["a", "b"], availableNow=True).awaitTermination()
    key = lambda r: r["id"]
    want = sorted(merge.merge_reports(spark.createDataFrame(log, LOG), ["a", "b"]).drop("synced_at", "reported_at").collect(), key=key)
    got = sorted(ingest.snapshot(spark, str(tmp_path / "out")).drop("synced_at", "reported_at").select(want[0].__fields__).collect(), key=key)
    assert got == want


def far(a, b, x, y):
    p, q = math.radians(a), math.radians(x)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(y - b) / 2) ** 2
    return 2 * 6_371_000 * math.asin(math.sqrt(min(1, h)))


@pytest.mark.parametrize("lat", [0.0, 26.0, -61.0])
def test_pairs_and_clusters_equal_brute_force(spark, lat):
    rng = random.Random(5)
    points = [(f"p{i:03d}", lat + rng.random() * 0.02, 92 + rng.random() * 0.03) for i in range(250)]
    points += [(f"q{i}", points[0][1], points[0][2]) for i in range(5)] + [("none", None, 92.0)]
    frame = spark.createDataFrame(points, "id string, lat double, lon double")
    located = [p for p in points if p[1] is not None]
    want = {tuple(sorted((a[0], b[0]))) for i, a in enumerate(located) for b in located[:i] if far(*a[1:], *b[1:]) <= 150}
    assert {(r["id_a"], r["id_b"]) for r in cluster.near_pairs(frame, 150.0).collect()} == want
    label = {p[0]: p[0] for p in points}
    changed = True
    while changed:
        changed = False
        for a, b in want:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    assert {r["id"]: r["cluster"] for r in cluster.clusters(frame, 150.0).repartition(3).collect()} == label


def test_components_of_chains_and_nothing(spark):
    chain = [(i, i + 1) for i in range(500)] + [(1000, 1001), (7000, 7000)]
    frame = spark.createDataFrame(chain, "a long, b long").repartition(7)
    got = {r["node"]: r["label"] for r in components.components(frame).collect()}
    assert got == {i: 0 for i in range(501)} | {1000: 1000, 1001: 1000}
    assert components.components(frame.limit(0)).count() == 0


def grid(spark, n=9):
    step = 200 / 111_194.9
    nodes = [(f"{r},{k}", 26 + r * step, 92 + k * step / math.cos(math.radians(26))) for r in range(n) for k in range(n)]
    edges = [(min(x, y), max(x, y), "highway" if r == s == 4 else "residential") for r in range(n) for k in range(n) for s, m in ((r, k + 1), (r + 1, k)) if s < n and m < n for x, y in [(f"{r},{k}", f"{s},{m}")]]
    nodes = spark.createDataFrame(nodes, "node_id string, lat double, lon double")
    return nodes, roads.with_lengths(nodes, spark.createDataFrame(edges, "a string, b string, road_type string"))


def zone(spark, rows):
    return spark.createDataFrame(rows, "cluster_id string, lat double, lon double, radius_m double, routing string, danger int, confidence double, danger_name string, newest_age_hours double")


def test_detour_trapped_and_last_resort(spark):
    nodes, edges = grid(spark)
    at = {r["node_id"]: (r["lat"], r["lon"]) for r in nodes.collect()}
    wet = zone(spark, [("z-1", *at["4,4"], 120.0, "block", 4, 0.9, "red", 1.0)])
    eff = effects.edge_effects(nodes, edges, wet, T)
    assert {r["a"] for r in eff.collect()} | {r["b"] for r in eff.collect()} <= {"4,4", "3,4", "5,4", "4,3", "4,5"}
    pairs = spark.createDataFrame([("q", "4,0", "4,8")], "query_id string, start string, goal string")
    naive = paths.route_pairs(pairs, nodes, edges, None, None, t=T, with_path=True).first()
    aware = paths.route_pairs(pairs, nodes, edges, eff, wet, t=T, with_path=True).first()
    assert "4,4" in naive["path"] and "4,4" not in aware["path"] and aware["found"]
    assert aware["distance_m"] > naive["distance_m"] and aware["travel_seconds"] > naive["travel_seconds"]
    ring = zone(spark, [(f"z-{k}", *at[k], 90.0, "block", 4, 0.9, "red", 1.0) for k in ("0,1", "1,0")])
    assert not paths.route_pairs(spark.createDataFrame([("q", "0,0", "4,8")], pairs.schema), nodes, edges, effects.edge_effects(nodes, edges, ring, T), ring, t=T).first()["found"]
    half = zone(spark, [("z-a", *at["0,1"], 90.0, "block", 4, 0.9, "red", 1.0), ("z-b", *at["1,0"], 90.0, "expensive", 2, 0.4, "restricted", 2.5)])
    eff = effects.edge_effects(nodes, edges, half, T)
    r = paths.route_pairs(spark.createDataFrame([("q", "0,0", "4,8")], pairs.schema), nodes, edges, eff, half, t=T).first()
    assert r["found"] and r["confidence"] == "uncertain" and r["evidence"] == "crosses 1 unconfirmed zone(s); newest supporting report 2.5 h old"
    shelters = spark.createDataFrame([("4,8", "s")], "node_id string, shelter_id string")
    assert {x["node_id"]: x["state"] for x in paths.trapped_nodes(nodes, edges, eff, shelters, t=T).collect()} == {"0,1": "trapped", "0,0": "uncertain only", "1,0": "uncertain only"}
    assert eff.where("effect = 'block'").count() == 3


def test_full_shelters_are_no_goal(spark):
    nodes, edges = grid(spark, 4)
    at = {r["node_id"]: (r["lat"], r["lon"]) for r in nodes.collect()}
    kind = "id string, name string, lat double, lon double, capacity int, occupied int, status string"
    zones = spark.createDataFrame([("near", "n", *at["0,1"], 10, 10, "open"), ("far", "f", *at["3,3"], 10, 2, "open")], kind)
    none = zone(spark, [])
    origins = spark.createDataFrame([("me", *at["0,0"])], "id string, lat double, lon double")
    eff = effects.edge_effects(nodes, edges, none, T)
    r = paths.routes_to_safety(origins, nodes, edges, none, eff, zones, t=T, with_path=True).first()
    assert r["found"] and r["shelter_id"] == "far" and r["snapped_m"] == 0.0 and r["path"][0] == "0,0" and r["path"][-1] == "3,3"
    full = zones.withColumn("occupied", F.col("capacity"))
    r = paths.routes_to_safety(origins, nodes, edges, none, eff, full, t=T).first()
    assert not r["found"] and r["reason"] == "every known safe zone is full or closed"


def test_tiles_give_the_costs_of_one_search(spark):
    nodes, edges = grid(spark)
    goals = spark.createDataFrame([("s", "4,4"), ("s", "0,8")], "scenario string, node string")
    costs = paths.edge_costs(edges, None, "s", t=T)
    whole = {r["node"]: round(r["cost"], 6) for r in paths.cheapest(nodes, costs, goals, T).collect()}
    tiled = {r["node"]: round(r["cost"], 6) for r in paths.cheapest(nodes, costs, goals, Tuning(tile_nodes=10)).collect()}
    assert whole == tiled and len(whole) == 81
    labels = paths.cheapest(nodes, costs, goals, Tuning(tile_nodes=10))
    routes = paths.follow(nodes, labels, spark.createDataFrame([("s", "8,8"), ("s", "4,4")], "scenario string, start string"), Tuning(tile_nodes=10)).collect()
    for r in routes:
        assert r["path"][0] == r["start"] and r["path"][-1] in ("4,4", "0,8")
        if r["start"] == "8,8":
            assert len(r["path"]) >= 9


def test_nearest_node_equals_brute_force(spark):
    nodes, _ = grid(spark)
    rng = random.Random(9)
    points = [(f"p{i}", 26 + rng.uniform(-0.05, 0.06), 92 + rng.uniform(-0.05, 0.06)) for i in range(50)] + [("away", 10.0, 50.0)]
    got = {r["id"]: r["metres"] for r in nearest.nearest_node(spark.createDataFrame(points, "id string, lat double, lon double"), nodes).collect()}
    every = [(r["lat"], r["lon"]) for r in nodes.collect()]
    for i, lat, lon in points:
        assert abs(got[i] - min(far(lat, lon, *n) for n in every)) < 1e-3


def test_segment_over_the_middle(spark):
    row = spark.createDataFrame([(26.0, 92.0, 26.0, 92.02, 26.0005, 92.01)], "a double, b double, x double, y double, lat double, lon double")
    d = row.select(c.segment_distance_m(*(F.col(k) for k in ("a", "b", "x", "y", "lat", "lon"))).alias("d")).first()["d"]
    assert 55 < d < 56


def test_readers(spark, tmp_path):
    (tmp_path / "up.json").write_text('{"reports": [{"id": "r1", "device_id": "d", "counter": 2, "phone_time": 5, "changed": ["rising"]}], "last_cursor": 0}\n')
    r = tables.read_edit_log(spark, str(tmp_path / "up.json")).first()
    assert (r["id"], r["source"], r["location_confidence"], r["changed"], r["water_level"]) == ("r1", "volunteer", 1.0, ["rising"], None)
    (tmp_path / "osm.json").write_text('{"elements": [{"type": "node", "id": 1, "lat": 26.0, "lon": 92.0}, {"type": "node", "id": 2, "lat": 26.001, "lon": 92.0}, {"type": "way", "id": 9, "nodes": [1, 2, 3], "tags": {"highway": "primary"}}]}')
    nodes, members = tables.read_osm(spark, str(tmp_path / "osm.json"))
    edges = roads.build_edges(nodes, members).collect()
    assert [(e["a"], e["b"], e["road_type"]) for e in edges] == [("1", "2", "main")]
    tables.reset(spark, str(tmp_path / "reports"))
    assert tables.read_reports(spark, str(tmp_path / "reports")).count() == 0
    out = tables.decode_json(spark.createDataFrame([("[\"a\"]", "oops")], "photo_ids string, polygon string")).first()
    assert out["photos"] == ["a"] and out["outline"] is None and out["polygon"] == "oops"


def plain(x):
    if x is None or x != x:
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


@pytest.mark.parametrize("name", ["severity", "why", "merge_reports", "stream_merge", "held_reports", "danger_zones", "build_edges", "evacuation", "radius_sweep"])
def test_queries_equal_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in "customer supplier orders lineitem events".split():
        db.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    found = db.execute(entry.oracle_sql()[name])
    names = [x[0] for x in found.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted([tuple(plain(r[i]) for i in order) for r in found.fetchall()], key=str)
    frame = entry.queries()[name](spark, d)
    got = sorted([tuple(plain(r[k]) for k in sorted(names)) for r in frame.collect()], key=str)
    assert sorted(frame.columns) == sorted(names) and got == want


def test_far_points_find_the_nearest_node(spark):
    import math
    import random

    rng = random.Random(5)
    places = [(f"n{i}", rng.uniform(-60, 70), rng.uniform(-180, 180)) for i in range(120)] + [(f"m{i}", 26 + i * 0.001, 92.0) for i in range(40)]
    points = [(f"p{i}", rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(60)] + [("pole", 90.0, 0.0), ("line", 0.0, 180.0), ("none", None, 1.0)]

    def metres(a, b, c, d):
        h = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
        return 2 * 6_371_000 * math.asin(math.sqrt(min(1.0, h)))

    nodes = spark.createDataFrame(places, "node_id string, lat double, lon double")
    got = {r["id"]: r["metres"] for r in nearest.nearest_node(spark.createDataFrame(points, "id string, lat double, lon double"), nodes).collect()}
    want = {i: min(metres(a, b, c, d) for _, c, d in places) for i, a, b in points if a is not None}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-3 for i in want)
    assert nearest.nearest_node(spark.createDataFrame(points, "id string, lat double, lon double"), nodes.limit(0)).count() == 0


def test_tiles_hold_few_nodes(spark):
    rows = [(f"n{i}", 26 + (i % 40) * 0.001, 92 + (i // 40) * 0.001) for i in range(800)] + [(f"f{i}", -40.0 + i, 10.0) for i in range(5)]
    got = paths.tiles(spark.createDataFrame(rows, "node_id string, lat double, lon double"), Tuning(tile_nodes=50))
    sizes = [r["count"] for r in got.groupBy("tile").count().collect()]
    assert got.count() == len(rows) and max(sizes) <= 50 and len(sizes) < 80


def test_reports_by_id(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(1)
    assert rows.count() == 1
    from hazardmap.plans.queries import QUERIES

    got = QUERIES["report_by_id"](spark, "/root/testdata/sf0.001").collect()
    assert all((r["severity"] is None) == (not r["found"]) and r["found"] == r["id"].startswith("r") for r in got) and got


def test_shared_folder_is_asked_for_on_a_cluster():
    from types import SimpleNamespace

    from hazardmap.sources.shared import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    with pytest.raises(ValueError):
        shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getConf=lambda: conf)))


def test_json_columns_and_trimmed_network(spark):
    from hazardmap.sources.tables import decode_json, encode_json

    rows = spark.createDataFrame([("a", ["p1", "p2"], [[1.0, 2.0]]), ("b", None, None)], "id string, photo_ids array<string>, polygon array<array<double>>")
    text = encode_json(rows)
    assert dict(text.dtypes)["photo_ids"] == dict(text.dtypes)["polygon"] == "string"
    back = decode_json(text).select("id", "photos", "outline").orderBy("id").collect()
    assert [tuple(r) for r in back] == [("a", ["p1", "p2"], [[1.0, 2.0]]), ("b", None, None)]
    members = danger.zone_members(danger.placed(fixtures.reports(spark, "/root/testdata/sf0.001"), T), T)
    zones = danger.danger_zones(fixtures.reports(spark, "/root/testdata/sf0.001"), T, with_ids=True).select("cluster_id", F.explode("report_ids").alias("report_id"))
    assert zones.join(members, ["cluster_id", "report_id"], "left_anti").isEmpty()


def test_danger_zones_name_their_reports(spark):
    import __spark_entry__ as entry

    d = "/root/testdata/sf0.001"
    zones = {r["cluster_id"]: r for r in entry.queries()["danger_zones"](spark, d).collect()}
    members = {}
    for r in entry.queries()["zone_members"](spark, d).collect():
        members.setdefault(r["cluster_id"], []).append(r["report_id"])
    assert zones and any(z["held_count"] > 0 for z in zones.values())
    for k, z in zones.items():
        assert z["report_ids"] == ",".join(sorted(members[k])) and z["report_count"] == len(members[k])
