"""Streams and state against the same work done at once."""

import random

import pytest
from pyspark.sql import functions as F

from hazardmap.config import Tuning
from hazardmap.operators import cluster, danger, effects, live, merge
from hazardmap.sources import fixtures, tables
from hazardmap.streaming import ingest

D = "/root/testdata/sf0.001"
T = Tuning()
LOG = "id string, device_id string, counter long, arrival_seq long, arrival_ms long, phone_time long, people_count int, photo_ids array<string>, lat double, changed array<string>"
FIELDS = ["people_count", "photo_ids", "lat"]


def test_ten_ticks_equal_ten_rebuilds(spark):
    """Reports come, go and move at every tick, bridges between clusters among them."""
    rng = random.Random(12)
    now: dict[str, tuple[float, float]] = {}
    state = None
    place = lambda: (26 + rng.randrange(12) * 0.0012 + rng.random() * 1e-4, 92 + rng.randrange(6) * 0.0013)
    for n in range(6):
        added = {f"p{rng.randrange(90):02}": place() for _ in range(14)} | ({f"x{n}": (None, 92.0)} if n % 2 else {})
        gone = {i for i in rng.sample(sorted(now), min(len(now), 8)) if i not in added} | {"never seen"}
        now = {k: v for k, v in {**now, **added}.items() if k not in gone and v[0] is not None}
        kinds = "id string, lat double, lon double"
        state = live.advance(state, spark.createDataFrame([(k, *v) for k, v in added.items()], kinds), spark.createDataFrame([(i,) for i in gone], "id string"))
        want = cluster.clusters(spark.createDataFrame([(k, *v) for k, v in now.items()], kinds), 150.0)
        assert {tuple(r) for r in state.select("id", "cluster").collect()} == {tuple(r) for r in want.collect()}, n
        assert state.count() == len(now)


def test_live_map_takes_up_changes_and_ticks_again(spark, tmp_path):
    reports, path = fixtures.reports(spark, D), str(tmp_path / "map")
    half = F.pmod(F.xxhash64("id"), F.lit(2)) == 0
    for _ in range(2):  # a tick that is run again changes nothing
        ingest.map_batch(spark, path, 0, reports.where(half), T)
    ingest.map_batch(spark, path, 1, reports.where(~half), T)
    key = lambda df: sorted(map(str, df.withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)}).collect()))
    first = spark.read.parquet(f"{path}/zones/version=1")
    assert key(first) == key(danger.danger_zones(reports, T))
    ingest.refresh_map(spark, path, 1, Tuning(now_ms=T.now_ms + 6 * 3_600_000))
    second = spark.read.parquet(f"{path}/zones/version=1")
    assert 0 < second.count() and second.where("routing = 'block'").isEmpty()  # all of it is stale by then
    fresh = ingest.refresh_severity(reports.withColumn("updated_at", F.col("synced_at")), T.now_ms - 3_600_000, T)
    assert 0 < fresh.count() < reports.count() and fresh.where("severity is null").isEmpty()


def test_live_map_stream(spark, tmp_path):
    reports = fixtures.reports(spark, D).limit(300)
    for k in range(2):
        reports.where(F.pmod(F.hash("id"), F.lit(2)) == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changes = spark.readStream.schema(reports.schema).parquet(str(tmp_path / "in"))
        ingest.start_live_map(changes, str(tmp_path / "map"), str(tmp_path / "check"), lambda: T.now_ms, availableNow=True).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "map/reports/version=1")).count() == 300
    assert spark.read.parquet(str(tmp_path / "map/zones/version=1")).count() == danger.danger_zones(reports, T).count()


def uploads(rng, n, start=0):
    out = []
    for k in range(start, start + n):
        changed = rng.choice([None, [], ["people_count"], ["lat", "photo_ids"], ["other"]])
        out.append((f"r{rng.randrange(6)}", f"d{k % 3}", rng.randrange(6), k, 1_000_000 + k * 1000, k, rng.choice([None, 1, 2, 3]), rng.choice([None, [], ["a", None], ["b"]]), rng.choice([None, 1.5]), changed))
    return out


def test_keyed_state_over_restarts_and_a_chained_feed(spark, tmp_path):
    rng = random.Random(21)
    at = {k: str(tmp_path / k) for k in ("in", "feed", "out", "c1", "c2")}
    log = []
    for k in range(3):
        rows = uploads(rng, 60, 60 * k)
        rng.shuffle(rows)
        log += rows
        spark.createDataFrame(rows + rows[:10], LOG).repartition(3).write.mode("append").parquet(at["in"])
        ingest.start_merge(spark.readStream.schema(LOG).parquet(at["in"]), at["feed"], at["c1"], FIELDS, availableNow=True).awaitTermination()
        ingest.start_feed(spark, at["feed"], at["out"], at["c2"], availableNow=True).awaitTermination()
    want = {r["id"]: r for r in merge.merge_reports(spark.createDataFrame(log, LOG), FIELDS).collect()}
    for where in ("feed", "out"):
        got = ingest.snapshot(spark, at[where])
        assert {r["id"]: r for r in got.select(*next(iter(want.values())).__fields__).collect()} == want
    feed, out = (spark.read.parquet(at[k]) for k in ("feed", "out"))
    assert feed.count() == out.count() == feed.distinct().count() and feed.exceptAll(out).isEmpty()


def test_state_expires_by_the_watermark(spark, tmp_path):
    at = {k: str(tmp_path / k) for k in ("in", "feed", "check")}
    minute = 60_000
    start = 1_735_000_000_000 // minute
    row = lambda i, counter, minutes, n: (i, "d", counter, minutes, (start + minutes) * minute, minutes, n, None, None, ["people_count"])
    steps = [[row("a", 5, 0, 1)], [row("b", 1, 30, 1)], [row("a", 6, 50, 2)], [row("b", 2, 200, 9)], [row("c", 1, 201, 1), row("a", 7, 40, 3)], [row("a", 1, 400, 4)]]
    sizes = []
    for rows in steps:
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(at["in"])
        q = ingest.start_merge(spark.readStream.schema(LOG).parquet(at["in"]), at["feed"], at["check"], FIELDS, keep_ms=60 * minute, delay="10 minutes", availableNow=True)
        q.awaitTermination()
        sizes.append([s["numRowsTotal"] for p in q.recentProgress for s in p["stateOperators"]][-1])
    feed = [(r["id"], r["counter"], r["people_count"], r["updated_at"] // minute - start) for r in spark.read.parquet(at["feed"]).orderBy("updated_at", "id").collect()]
    # a's edit after 50 minutes meets its state; its late upload of minute 40 is dropped; it begins anew after its state went
    assert feed == [("a", 5, 1, 0), ("b", 1, 1, 30), ("a", 6, 2, 50), ("b", 2, 9, 200), ("c", 1, 1, 201), ("a", 1, 4, 400)]
    assert max(sizes) <= 8  # rows of the row state and of timers, of the ids that are alive


def test_a_bad_map_is_not_published(spark, tmp_path):
    nodes, edges = fixtures.view(spark, D, "road_nodes"), fixtures.view(spark, D, "road_edges")
    zones, path = danger.danger_zones(fixtures.reports(spark, D), T), str(tmp_path / "map")
    away = zones.withColumn("lat", F.col("lat") + 10)
    with pytest.raises(effects.GateError):
        effects.publish_map(away, nodes, edges, path, T)
    near = zones.where("routing = 'block'").join(effects.zones_on_roads(nodes, edges, zones).select("cluster_id"), "cluster_id", "left_semi")
    assert near.count() > 0
    effects.publish_map(near, nodes, edges, path, T)
    n = spark.read.parquet(path).count()
    with pytest.raises(effects.GateError):
        effects.publish_map(away, nodes, edges, path, T)
    assert spark.read.parquet(path).count() == n == near.count()


def test_partitions_are_replaced_alone(spark, tmp_path):
    path = str(tmp_path / "days")
    df = spark.createDataFrame([(d, f"r{i}") for d in (1, 2) for i in range(5)], "day int, id string").coalesce(1)
    tables.write_snapshot(df, path, ["day"])
    files = lambda d: sorted(p.name for p in (tmp_path / "days" / f"day={d}").glob("*.parquet"))
    before = files(1), files(2)
    tables.write_snapshot(df.where("day = 2").withColumn("id", F.upper("id")), path, ["day"])
    assert files(1) == before[0] and files(2) != before[1]
    assert {r["id"] for r in spark.read.parquet(path).where("day = 2").collect()} == {f"R{i}" for i in range(5)} and spark.read.parquet(path).count() == 10


def test_look_ups_pass_over_row_groups(spark, tmp_path):
    path = str(tmp_path / "ids")
    rows = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("id"), F.rand(1).alias("x"))
    tables.write_by_id(rows, path, group_bytes=1 << 18)
    ids = [r["id"] for r in rows.where("x < 0.00002").collect()] + ["none"]
    got = tables.look_up(spark, path, ids)
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters: [In(id" in plan or "PushedFilters: [IsNotNull(id), In(id" in plan or "EqualTo(id" in plan
    assert sorted(r["id"] for r in got.collect()) == sorted(ids[:-1])
    read = _scanned(got)
    assert 0 < read < 150_000


def _scanned(df):
    """Rows that a plan's scans gave, run once more."""
    df = df.select("*")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    total = 0
    for i in range(leaves.size()):
        metric = leaves.apply(i).metrics().get("numOutputRows")
        if metric.isDefined():
            total += metric.get().value()
    return total


def test_json_lines_with_bad_ones(spark, tmp_path):
    lines = ['{"reports": [{"id": "a", "water_level": "", "changed": ["lat"], "lat": 1.5}, {"id": "b", "photo_ids": ["p"]}], "last_cursor": 4}', "", "   ", '{"reports": [{"id": "c"', "[1, 2", "null text", '{"reports": []}', '{"reports": [{"id": 7, "lat": "north"}]}', '{"other": 1}']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "up"))
    rows, bad = tables.read_uploads(spark, str(tmp_path / "up"))
    got = {r["id"]: r for r in rows.collect()}
    assert got["a"]["water_level"] is None and got["a"]["changed"] == ["lat"] and got["a"]["road_passable"] == "unknown" and got["b"]["photo_ids"] == ["p"] and got["b"]["changed"] == []
    assert {"a", "b"} == set(got)
    assert {r["value"] for r in bad.collect()} == {lines[3], lines[4], lines[5], lines[7]}
    nodes = spark.createDataFrame([("1", 26.0, 92.0), ("2", 26.1, None)], "node_id string, lat double, lon double")
    ways = spark.createDataFrame([(9, 1, "1", "track"), (9, 2, "2", "track"), (8, 1, "2", None)], "way_id long, pos long, node_id string, highway string")
    tables.encode_osm(nodes, ways).unionByName(spark.createDataFrame([("{",)], "value string")).write.text(str(tmp_path / "osm"))
    n, m, lost = tables.read_osm_lines(spark, str(tmp_path / "osm"))
    assert {tuple(r) for r in n.collect()} == {("1", 26.0, 92.0), ("2", 26.1, None)} and lost.count() == 1
    assert {(r["way_id"], r["node_id"], r["highway"]) for r in m.collect()} == {(9, "1", "track"), (9, "2", "track"), (8, "2", None)}


def test_a_crowd_costs_its_places(spark, monkeypatch):
    """Reports of one place are one node of a tick's graph, however many there are."""
    sizes = []
    found = live.components
    monkeypatch.setattr(live, "components", lambda links: (sizes.append(links.count()), found(links))[1])
    crowd = lambda a, b: spark.createDataFrame([(f"c{i:03}", 26.0 + i % 3 * 1e-5, 92.0 + i // 150 * 0.0012) for i in range(a, b)], "id string, lat double, lon double")
    state = live.advance(live.advance(None, crowd(0, 200)), crowd(200, 300))
    assert {r["cluster"] for r in state.collect()} == {"c000"} and state.count() == 300
    assert max(sizes) <= 12


def test_long_jobs_have_garbage_collected(spark, monkeypatch):
    from hazardmap.sources import shared

    asked = []
    monkeypatch.setattr(shared.gc, "collect", lambda: asked.append(1))
    for s in (3600.0, 0.0):
        monkeypatch.setattr(shared, "TIDY_S", s)
        monkeypatch.setattr(shared, "_tidied", shared.time.monotonic())
        assert shared.keep(spark.range(3), "rows").count() == 3
    assert len(asked) == 1
