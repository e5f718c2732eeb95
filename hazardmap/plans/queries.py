"""The registered queries: each job over the views of a tables' folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Tuning
from ..functions import columns as c
from ..operators import cluster, danger, effects, evaluate, live, merge, nearest, paths, roads
from ..sources import fixtures
from ..sources.shared import keep, shared_dir
from ..sources import tables
from ..sources.tables import decode_json
from ..streaming import ingest

T = Tuning()
FIELDS = ["people_count", "water_level", "road_passable"]
BOX = (26.0, 92.0, 26.02, 92.06)
KINDS = ["motorway", "primary", "tertiary", "track"]
CURSOR = 1_735_000_500_000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _view(name: str):
    return lambda spark, d: fixtures.view(spark, d, name)


_nodes, _edges, _shelters, _incidents, _members = map(_view, ("road_nodes", "road_edges", "safe_zones", "incidents", "way_members"))


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return danger.placed(fixtures.reports(spark, d), T)


def _zones(spark: SparkSession, d: str) -> DataFrame:
    return keep(danger.drawn(danger.all_zones(_placed(spark, d), T), T), "zones")


def _lengths(spark: SparkSession, d: str) -> DataFrame:
    return roads.with_lengths(_nodes(spark, d), _edges(spark, d))


def _effects(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    zones = _zones(spark, d)
    return zones, keep(effects.edge_effects(_nodes(spark, d), _edges(spark, d), zones, T), "effects")


def _goals(spark: SparkSession, d: str) -> DataFrame:
    return keep(nearest.shelter_nodes(_shelters(spark, d), _nodes(spark, d)), "goals")


@query
def severity(spark, d):
    return fixtures.reports(spark, d).select("id", c.severity(T).alias("severity"), F.round(c.hours_waiting(T), 6).alias("hours"))


@query
def why(spark, d):
    return fixtures.reports(spark, d).select("id", F.concat_ws("; ", c.reasons(T)).alias("why"))


@query
def triage(spark, d):
    rows = fixtures.reports(spark, d).select("id", c.severity(T).alias("severity"), "reported_at")
    return rows.orderBy(F.desc("severity"), "reported_at", "id")


@query
def triage_top(spark, d):
    return triage(spark, d).limit(100)


@query
def weights(spark, d):
    return fixtures.reports(spark, d).select("id", F.round(c.report_weight(T), 9).alias("weight"))


@query
def held_unlocated(spark, d):
    return fixtures.reports(spark, d).where(~c.located()).select(F.col("id").alias("report_id"), F.lit("no usable location").alias("reason"))


@query
def merge_reports(spark, d):
    return merge.merge_reports(fixtures.edit_log(spark, d), FIELDS)


@query
def merge_outcomes(spark, d):
    return merge.merge_outcomes(fixtures.edit_log(spark, d), FIELDS)


@query
def edit_outcomes(spark, d):
    return merge.judge_edits(fixtures.edit_log(spark, d), FIELDS).select("arrival_seq", "id", "outcome")


@query
def delta_sync(spark, d):
    return merge.changes_since(merge_reports(spark, d), CURSOR).select("id", "counter", "updated_at")


@query
def delta_cursor(spark, d):
    return merge.next_cursor(merge_reports(spark, d), CURSOR)


@query
def json_fields(spark, d):
    """Photo lists written as JSON text, some of it malformed, and read again."""
    rows = fixtures.reports(spark, d).select(
        "id",
        F.when(F.substring("id", 2, 12).cast("long") % 5 == 0, F.lit("not json")).otherwise(F.concat(F.lit('["'), F.col("device_id"), F.lit('","'), F.col("source"), F.lit('"]'))).alias("photo_ids"),
        F.when(c.located(), F.lit("[[26.0,92.0],[26.5,92.5]]")).alias("polygon"),
    )
    decoded = decode_json(rows)
    return decoded.select("id", F.when(F.col("photos").isNull(), -1).otherwise(F.size("photos")).alias("n_photos"), F.col("photos")[0].alias("first_photo"), F.col("outline")[1][0].alias("second_lat"))


@query
def near_pairs(spark, d):
    return cluster.near_pairs(fixtures.reports(spark, d), T.radius_m).select("id_a", "id_b", F.round("metres", 3).alias("metres"))


@query
def clusters(spark, d):
    return cluster.clusters(fixtures.reports(spark, d), T.radius_m)


@query
def confidence(spark, d):
    return danger.confidence(_placed(spark, d), T, ["cluster"])


@query
def danger_level(spark, d):
    return danger.level(_placed(spark, d), T, ["cluster"])


@query
def held_reports(spark, d):
    return danger.held_reports(_placed(spark, d), fixtures.reports(spark, d), T)


@query
def zone_geometry(spark, d):
    g = danger.zone_geometry(_placed(spark, d), T)
    return g.select("cluster", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), "radius_m")


@query
def zone_routing(spark, d):
    return danger.all_zones(_placed(spark, d), T).select("cluster_id", "danger", "confidence", "newest_age_hours", "routing")


@query
def danger_zones(spark, d):
    z = danger.danger_zones(fixtures.reports(spark, d), T, with_ids=True)
    return z.withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9), "report_ids": F.array_join("report_ids", ",")})


@query
def zone_members(spark, d):
    """Supporting reports of all zones, drawn or not."""
    return danger.zone_members(_placed(spark, d), T)


@query
def map_stats(spark, d):
    return danger.map_stats(fixtures.reports(spark, d), T)


@query
def decay_curve(spark, d):
    return danger.decay_curve(fixtures.reports(spark, d), [0.0, 3.0, 6.0, 12.0], T)


@query
def osm_counts(spark, d):
    return roads.osm_counts(_nodes(spark, d), _members(spark, d))


@query
def osm_extract(spark, d):
    nodes, ways = roads.osm_extract(_nodes(spark, d), _members(spark, d), BOX, KINDS)
    kept = nodes.agg(F.count("*").alias("nodes"), F.min("node_id").alias("least"), F.max("node_id").alias("most"))
    return ways.groupBy("highway").agg(F.count_distinct("way_id").alias("ways"), F.count("*").alias("members")).crossJoin(kept)


@query
def fit_bbox(spark, d):
    return roads.fit_bbox(_nodes(spark, d), 26.02, 92.05, budget=300).select("step", F.round("half_km", 6).alias("half_km"), "nodes")


@query
def road_types(spark, d):
    return roads.road_types(_members(spark, d))


@query
def road_quality(spark, d):
    return roads.quality_counts(_nodes(spark, d).where(F.col("node_id").cast("int") % 10 != 3), _members(spark, d))


@query
def build_edges(spark, d):
    nodes = _nodes(spark, d).where(F.col("node_id").cast("int") % 10 != 3)
    return roads.build_edges(nodes, _members(spark, d)).withColumn("length_m", F.round("length_m", 3))


@query
def edge_lengths(spark, d):
    return _lengths(spark, d).select("a", "b", F.round("length_m", 3).alias("length_m"))


@query
def travel_seconds(spark, d):
    drive, walk = (c.travel_seconds(F.col("length_m"), F.col("road_type"), m, T) for m in ("drive", "walk"))
    return _lengths(spark, d).select("a", "b", F.round(drive, 3).alias("drive_s"), F.round(walk, 3).alias("walk_s"))


@query
def road_components(spark, d):
    edges = _edges(spark, d).where((F.col("a").cast("int") % 50 != 25) & (F.col("b").cast("int") % 50 != 25))
    named = roads.road_components(_nodes(spark, d), edges)
    return named.groupBy("component").agg(F.count("*").alias("nodes"))


@query
def nearest_node(spark, d):
    found = nearest.nearest_node(fixtures.reports(spark, d), _nodes(spark, d))
    return found.select("id", F.round("metres", 2).alias("metres"))


@query
def open_shelters(spark, d):
    return nearest.open_shelters(_shelters(spark, d)).select("id", "name", "capacity", "occupied")


@query
def shelter_nodes(spark, d):
    return _goals(spark, d)


@query
def safe_zone_upsert(spark, d):
    zones = _shelters(spark, d)
    newer = zones.where(F.length("id") % 2 == 1).withColumns({"occupied": F.col("occupied") + 20, "arrival_seq": F.lit(1).cast("long")})
    return merge.upsert_safe_zones(zones, newer).select("id", "capacity", "occupied", "status")


@query
def edge_effects(spark, d):
    return _effects(spark, d)[1]


@query
def zones_on_roads(spark, d):
    return effects.zones_on_roads(_nodes(spark, d), _edges(spark, d), _zones(spark, d)).select("cluster_id", "routing")


@query
def roads_export(spark, d):
    return _edges(spark, d).select("a", "b").distinct()


@query
def roads_nodes(spark, d):
    return _nodes(spark, d).select("node_id", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query
def roads_blocked(spark, d):
    return _effects(spark, d)[1].where(F.col("effect") == "block").select("a", "b", "cluster_id")


@query
def roads_penalised(spark, d):
    return _effects(spark, d)[1].where(F.col("effect") == "expensive").select("a", "b", "multiplier", "cluster_id")


@query
def report_by_id(spark, d):
    """Every twentieth report's severity and reasons, and as many ids that no report has."""
    ids = spark.read.parquet(f"{d}/events.parquet").where("event_id % 20 = 0").select(F.explode(F.array(F.concat(F.lit("r"), F.col("event_id")), F.concat(F.lit("none"), F.col("event_id")))).alias("id"))
    return merge.reports_by_id(fixtures.reports(spark, d), ids, T)


@query
def quality_gate(spark, d):
    return effects.quality_gate(_nodes(spark, d), _edges(spark, d), _zones(spark, d), T)


@query
def evacuation(spark, d):
    _, eff = _effects(spark, d)
    table = paths.evacuation_table(_nodes(spark, d), _lengths(spark, d), eff, _goals(spark, d), t=T)
    return table.select("node_id", "found", F.round("cost", 3).alias("seconds"))


@query
def evacuation_strict(spark, d):
    _, eff = _effects(spark, d)
    small = Tuning(tile_nodes=400)  # routes cross many tiles
    table = paths.evacuation_table(_nodes(spark, d), _lengths(spark, d), eff, _goals(spark, d), mode="walk", allow_uncertain=False, t=small)
    return table.select("node_id", "found", F.round("cost", 3).alias("seconds"))


@query
def trapped_nodes(spark, d):
    _, eff = _effects(spark, d)
    return paths.trapped_nodes(_nodes(spark, d), _lengths(spark, d), eff, _goals(spark, d), t=T)


@query
def routes_to_safety(spark, d):
    zones, eff = _effects(spark, d)
    origins = fixtures.reports(spark, d).select("id", "lat", "lon")
    r = paths.routes_to_safety(origins, _nodes(spark, d), _lengths(spark, d), zones, eff, _shelters(spark, d), t=T)
    uncertain = F.when(F.col("crosses_uncertain").isNull(), 0).otherwise(F.size("crosses_uncertain")).cast("long").alias("uncertain_zones")
    return r.select("id", "snapped_m", "found", "shelter_id", F.round("travel_seconds", 1).alias("travel_seconds"), F.round("distance_m", 0).alias("distance_m"), uncertain, "confidence", "evidence", "reason")


@query
def forced_detours(spark, d):
    _, eff = _effects(spark, d)
    r = paths.forced_detours(_nodes(spark, d), _lengths(spark, d), eff, _goals(spark, d), t=T)
    return r.select("start", *(F.round(f"{s}_seconds", 3).alias(f"{s}_seconds") for s in ("naive", "aware")), *(F.round(f"{s}_distance_m", 1).alias(f"{s}_distance_m") for s in ("naive", "aware")))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """A trip from every node to the next node whose number 500 divides (or to the last node)."""
    nodes = _nodes(spark, d).select(F.col("node_id").cast("long").alias("n"))
    last = F.broadcast(nodes.agg(F.max("n").alias("last")))  # one row
    trips = nodes.crossJoin(last).select(F.col("n").cast("string").alias("start"), F.least(F.ceil(F.col("n") / 500) * 500, "last").cast("string").alias("goal"))
    return trips.withColumn("query_id", F.concat_ws(">", "start", "goal"))


@query
def route_pairs(spark, d):
    zones, eff = _effects(spark, d)
    r = paths.route_pairs(_pairs(spark, d), _nodes(spark, d), _lengths(spark, d), eff, zones, t=T)
    return r.select("query_id", "found", "travel_seconds")


@query
def detour_cost(spark, d):
    zones, eff = _effects(spark, d)
    naive = paths.route_pairs(_pairs(spark, d), _nodes(spark, d), _lengths(spark, d), None, None, t=T).where("found")
    aware = paths.route_pairs(_pairs(spark, d), _nodes(spark, d), _lengths(spark, d), eff, zones, t=T).where("found")
    return evaluate.detour_cost(naive, aware).select("routes", F.round("extra_percent", 1).alias("extra_percent"))


@query
def score_geometry(spark, d):
    rows = _placed(spark, d)
    return evaluate.score_geometry(_zones(spark, d), _incidents(spark, d), danger.held_reports(rows, fixtures.reports(spark, d), T))


@query
def score_membership(spark, d):
    rows = _placed(spark, d)
    drawn = danger.drawn(danger.all_zones(rows, T), T).select("cluster_id")
    members = danger.zone_members(rows, T).join(drawn, "cluster_id", "left_semi")
    truth = fixtures.reports(spark, d).select(F.col("id").alias("report_id"), F.floor(F.substring("id", 2, 12).cast("long") / 8).cast("string").alias("incident_id"))
    return evaluate.score_membership(members, truth)


@query
def radius_sweep(spark, d):
    found = cluster.clusters_by_radius(fixtures.reports(spark, d), [75.0, 100.0, 150.0, 200.0])
    truth = fixtures.reports(spark, d).select("id", F.floor(F.substring("id", 2, 12).cast("long") / 8).alias("incident"))
    pairs = found.join(truth, "id").select("radius_m", "cluster", "incident").distinct()
    merges = pairs.groupBy("radius_m", "cluster").count().groupBy("radius_m").agg(F.count_if(F.col("count") > 1).alias("merges"))
    splits = pairs.groupBy("radius_m", "incident").count().groupBy("radius_m").agg(F.count_if(F.col("count") > 1).alias("splits"))
    return merges.join(splits, "radius_m")


def _scenes(spark: SparkSession, d: str) -> DataFrame:
    """All zones with a seed (their name's number by 7), reports and held reports: a table of scores."""
    zones = danger.all_zones(_placed(spark, d), T)
    number = F.regexp_extract("cluster_id", r"(\d+)$", 1).cast("long")
    return zones.select((number % 7).alias("seed"), "held_count", "report_count", (F.col("routing") != "ignore").cast("int").alias("shown"))


@query
def seed_stats(spark, d):
    by_seed = _scenes(spark, d).groupBy("seed").agg(F.sum("held_count").cast("double").alias("held"), F.sum("shown").cast("double").alias("shown"))
    long = by_seed.select(F.explode(F.array(F.struct(F.lit("held").alias("metric"), F.col("held").alias("value")), F.struct(F.lit("shown").alias("metric"), F.col("shown").alias("value")))).alias("r")).select("r.*")
    stats = evaluate.seed_stats(long)
    return stats.withColumns({k: F.round(k, 6) for k in ("mean", "stdev", "affected_share")})


@query
def accuracy_sweep(spark, d):
    scores = _scenes(spark, d).groupBy(((F.col("seed") + 3) / 10.0).alias("accuracy")).agg(
        F.sum("shown").alias("recovered"), F.count("*").alias("total"), F.sum("held_count").alias("held"), F.sum("report_count").alias("reports")
    )
    return evaluate.accuracy_sweep(scores).withColumns({k: F.round(k, 9) for k in ("recovery", "held_rate")})


@query
def route_crossings(spark, d):
    """Routes of all nodes to a shelter that enter danger zones, by what the route knew and by the zones' verdict."""
    zones, eff = _effects(spark, d)
    entered = paths.crossings(_nodes(spark, d), _lengths(spark, d), eff, zones, _goals(spark, d), t=T)
    by = {f"{s}_{r}": (F.col("scenario") == s) & (F.col("routing") == r) for s in ("naive", "aware") for r in ("block", "expensive")}
    return entered.agg(*(F.count_if(c).alias(f"{k}_routes") for k, c in by.items()), *(F.coalesce(F.sum(F.when(c, F.col("steps"))), F.lit(0)).alias(f"{k}_steps") for k, c in by.items()))


def _arrivals(spark: SparkSession, d: str, parts: int):
    """Writes the events in order of their id to a folder, a file at a time, and yields after each."""
    events = spark.read.parquet(f"{d}/events.parquet")
    where = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    cuts = events.agg(F.percentile_approx("event_id", [i / parts for i in range(1, parts)])).first()[0]
    for lo, hi in zip([None, *cuts], [*cuts, None]):
        part = events.where((F.lit(lo).isNull() | (F.col("event_id") > lo)) & (F.lit(hi).isNull() | (F.col("event_id") <= hi)))
        part.write.mode("append").parquet(f"{where}/events")
        yield where, events.schema


def _stream(spark: SparkSession, d: str, feed: bool) -> str:
    """The edit log in three arrivals, each merged by a stream started anew (and passed on by a second one)."""
    for where, schema in _arrivals(spark, d, 3):
        log = ingest.stream_files(spark, f"{where}/events", schema, "edit_log", 1000)
        ingest.start_merge(log, f"{where}/feed", f"{where}/merge-checkpoint", FIELDS, availableNow=True).awaitTermination()
        if feed:
            ingest.start_feed(spark, f"{where}/feed", f"{where}/out", f"{where}/feed-checkpoint", availableNow=True).awaitTermination()
    return where


@query
def stream_merge(spark, d):
    """The edit log streamed in several micro-batches over restarts; equal to merge_reports."""
    return ingest.snapshot(spark, f"{_stream(spark, d, False)}/feed")


@query
def stream_delta(spark, d):
    """What a second stream got from the first one's feed, after the cursor; equal to delta_sync."""
    got = spark.read.parquet(f"{_stream(spark, d, True)}/out")
    return merge.changes_since(ingest.newest(got), CURSOR).select("id", "counter", "updated_at")


@query
def live_map(spark, d):
    """The map after ten ticks that each bring a tenth of the reports; equal to danger_zones."""
    reports, state = fixtures.reports(spark, d), None
    for n in range(10):
        state = live.advance(state, reports.where(F.pmod(F.xxhash64("id"), F.lit(10)) == n), None, T.radius_m)
    z = live.zones_now(reports, state, T)
    return z.withColumns({"lat": F.round("lat", 9), "lon": F.round("lon", 9)})


def _uploads(spark: SparkSession, d: str) -> str:
    """The edit log as uploads of at most four reports, one JSON line each, with a cut line and a line of another kind after every tenth."""
    where = f"{shared_dir(spark)}/uploads-{uuid.uuid4().hex}"
    log = fixtures.edit_log(spark, d).withColumn("upload", F.concat_ws("-", "device_id", F.floor(F.col("arrival_seq") / 4).cast("string")))
    lines = tables.encode_uploads(log)
    bad = log.where("arrival_seq % 10 = 0").select(F.explode(F.array(F.concat(F.lit('{"reports": [{"id": "'), F.col("id")), F.concat(F.lit("no upload "), F.col("id")))).alias("value"))
    lines.unionByName(bad).write.text(where)
    return where


@query
def upload_json(spark, d):
    """The edit log after it went through JSON."""
    return tables.read_uploads(spark, _uploads(spark, d))[0].select("id", "device_id", "counter", "phone_time", "people_count", "water_level", "road_passable", F.array_join("changed", ",").alias("changed_csv"))


@query
def upload_quarantine(spark, d):
    """Lines of the uploads that are none."""
    return tables.read_uploads(spark, _uploads(spark, d))[1]


@query
def osm_json(spark, d):
    """Segments of ways after nodes and ways went through JSON lines, with the number of lines that are no element."""
    where = f"{shared_dir(spark)}/osm-{uuid.uuid4().hex}"
    bad = _nodes(spark, d).where("cast(node_id AS int) % 100 = 0").select(F.concat(F.lit('{"type": "node", "id": '), F.col("node_id")).alias("value"))
    tables.encode_osm(_nodes(spark, d), _members(spark, d)).unionByName(bad).write.text(where)
    nodes, members, lost = tables.read_osm_lines(spark, where)
    return members.groupBy("highway").agg(F.count_distinct("way_id").alias("ways"), F.count("*").alias("members")).crossJoin(nodes.agg(F.count("*").alias("nodes"), F.round(F.sum("lat"), 6).alias("lats"))).crossJoin(lost.agg(F.count("*").alias("bad_lines")))


@query
def report_lookup(spark, d):
    """The reports of the hundred most urgent ids, from a snapshot sorted by id."""
    where = f"{shared_dir(spark)}/by-id-{uuid.uuid4().hex}"
    tables.write_by_id(fixtures.reports(spark, d), where)
    ids = [r["id"] for r in triage_top(spark, d).select("id").collect()]  # a hundred
    return tables.look_up(spark, where, ids).select("id", "device_id", "reported_at")


@query
def map_instants(spark, d):
    """The decay curve at two instants, from a table by instant of which one was replaced."""
    where = f"{shared_dir(spark)}/instants-{uuid.uuid4().hex}"
    reports = fixtures.reports(spark, d)
    tables.write_snapshot(danger.decay_curve(reports, [0.0, 3.0, 6.0], T), where, ["hours"])
    tables.write_snapshot(danger.decay_curve(reports, [3.0], T), where, ["hours"])
    return spark.read.parquet(where).where("hours in (0.0, 3.0)").select("cluster", F.col("hours").cast("double").alias("hours"), "confidence", "danger")
