"""Road networks: OSM elements to nodes and edges, boxes, components."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import PLANE_DEGREE_M, ROAD_TYPES, Tuning
from ..functions.columns import haversine_m, lookup
from .components import components


def bbox(lat: float, lon: float, half_km: float) -> tuple[float, float, float, float]:
    """South, west, north, east of a square around a point."""
    dlat = half_km * 1000 / PLANE_DEGREE_M
    dlon = dlat / math.cos(math.radians(lat))
    return lat - dlat, lon - dlon, lat + dlat, lon + dlon


def in_box(box: tuple[float, float, float, float]) -> Column:
    return F.col("lat").between(box[0], box[2]) & F.col("lon").between(box[1], box[3])


def osm_extract(nodes: DataFrame, members: DataFrame, box: tuple[float, float, float, float], kinds: list[str]) -> tuple[DataFrame, DataFrame]:
    """Ways of the given kinds with a node in the box, and all nodes of these ways, inside the box or not."""
    ways = members.where(F.col("highway").isin(kinds))
    near = ways.join(nodes.where(in_box(box)).select("node_id"), "node_id", "left_semi").select("way_id").distinct()
    chosen = ways.join(near, "way_id", "left_semi")
    return nodes.join(chosen.select("node_id").distinct(), "node_id", "left_semi"), chosen


def osm_counts(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """One row: nodes, ways, and segments that the ways' lengths promise."""
    ways = members.groupBy("way_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("ways"), F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))), F.lit(0)).alias("segments"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(ways)


def fit_bbox(nodes: DataFrame, lat: float, lon: float, budget: int = 30_000, start_km: float = 13.0, shrink: float = 0.8, steps: int = 8) -> DataFrame:
    """One row: the largest box of a shrinking ladder that holds at most `budget` nodes, else the smallest: step, half_km, nodes."""
    ladder = [(k, start_km * shrink**k, *bbox(lat, lon, start_km * shrink**k)) for k in range(steps)]
    counts = nodes.agg(*(F.count_if(in_box(b[2:])).alias(f"n{b[0]}") for b in ladder))
    rows = counts.select(F.explode(F.array(*(F.struct(F.lit(b[0]).alias("step"), F.lit(b[1]).alias("half_km"), F.col(f"n{b[0]}").alias("nodes")) for b in ladder))).alias("r")).select("r.*")
    fits = (F.col("nodes") <= budget) | (F.col("step") == steps - 1)
    return rows.where(fits).agg(F.min_by(F.struct("step", "half_km", "nodes"), "step").alias("r")).select("r.*")


def road_types(members: DataFrame) -> DataFrame:
    """Ways by highway value with their road type; null where the value is not mapped and the way is dropped."""
    return members.groupBy("highway").agg(F.count_distinct("way_id").alias("ways")).withColumn("road_type", lookup(F.col("highway"), ROAD_TYPES))


def build_edges(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (a <= b as strings, length_m, road_type) between consecutive members of mapped ways.

    Segments with an end that has no coordinates are dropped; of repeated pairs the last way's type stays.
    """
    mapped = members.withColumn("road_type", lookup(F.col("highway"), ROAD_TYPES)).where(F.col("road_type").isNotNull())
    way = mapped.groupBy("way_id", "road_type").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("m"))  # a way's length is bounded
    pairs = F.expr("transform(sequence(1, size(m) - 1), i -> struct(m[i - 1].node_id AS u, m[i].node_id AS v, i AS seg))")
    seg = way.where(F.size("m") > 1).select("way_id", "road_type", F.explode(pairs).alias("s")).select("way_id", "road_type", "s.*")
    at = lambda end: nodes.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(F.col("node_id").alias(end), F.col("lat").alias(f"{end}_lat"), F.col("lon").alias(f"{end}_lon"))
    seg = seg.join(at("u"), "u").join(at("v"), "v")
    metres = haversine_m(F.col("u_lat"), F.col("u_lon"), F.col("v_lat"), F.col("v_lon"))
    out = seg.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), metres.alias("m"), "road_type", F.struct("way_id", "seg").alias("place"))
    return out.groupBy("a", "b").agg(F.max_by(F.struct("m", "road_type"), "place").alias("e")).select("a", "b", F.col("e.m").alias("length_m"), F.col("e.road_type").alias("road_type"))


def with_lengths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges with both ends' coordinates and length_m; edges with an unknown end are dropped."""
    at = lambda e: nodes.select(F.col("node_id").alias(e), F.col("lat").alias(f"{e}lat"), F.col("lon").alias(f"{e}lon"))
    both = edges.drop("alat", "alon", "blat", "blon", "length_m").join(at("a"), "a").join(at("b"), "b")
    return both.withColumn("length_m", haversine_m(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")))


def road_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node_id, component) of every node; a node without edges is its own."""
    labels = components(edges.select("a", "b"))
    return nodes.select("node_id").join(labels, F.col("node_id") == F.col("node"), "left").select("node_id", F.coalesce("label", "node_id").alias("component"))


def trim_network(nodes: DataFrame, edges: DataFrame, t: Tuning = Tuning()) -> tuple[DataFrame, DataFrame]:
    """Only the largest component, if it holds less than largest_share of the nodes; else all of it."""
    named = road_components(nodes, edges)
    sizes = named.groupBy("component").agg(F.count("*").alias("n"))
    top = sizes.agg(F.max_by("component", F.struct("n", "component")).alias("component"), F.max("n").alias("n"), F.sum("n").alias("all")).first()
    if top is None or top["n"] is None or top["n"] >= t.largest_share * top["all"]:
        return nodes, edges
    kept = named.where(F.col("component") == top["component"]).select("node_id")
    return nodes.join(kept, "node_id", "left_semi"), edges.join(kept, F.col("a") == F.col("node_id"), "left_semi")


def quality_counts(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """One row: ways of unmapped kinds, and members whose node has no coordinates."""
    ways = members.groupBy("way_id", "highway").agg(F.count("*").alias("n")).agg(F.count_if(lookup(F.col("highway"), ROAD_TYPES).isNull()).alias("unmapped_ways"))
    known = nodes.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("node_id")
    return ways.crossJoin(members.join(known, "node_id", "left_anti").agg(F.count("*").alias("members_without_place")))
