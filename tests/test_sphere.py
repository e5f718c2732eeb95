"""Distance joins on the whole sphere against all pairs."""

import itertools
import math
import random

import pytest

from hazardmap.operators import cluster, nearest

R = 6_371_000.0


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * R * math.asin(math.sqrt(min(1.0, h)))


def scatter(rng, lat, lon, spread_m, n):
    """Points round a place, over a pole or the date line where it comes to that."""
    out = []
    for _ in range(n):
        d, turn = spread_m / R * math.sqrt(rng.random()), 2 * math.pi * rng.random()
        p = math.radians(lat)
        q = math.asin(max(-1.0, min(1.0, math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(turn))))
        x = math.radians(lon) + math.atan2(math.sin(turn) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(q))
        out.append((math.degrees(q), (math.degrees(x) + 180) % 360 - 180))
    return out


PLACES = [(0.0, 0.0), (26.25, 92.34), (60.0, 179.9995), (-45.0, -180.0), (89.9995, 10.0), (-90.0, 0.0), (89.9, 77.0), (0.0, 180.0)]


@pytest.mark.parametrize("radius", [150.0, 40_000.0])
def test_pairs_and_clusters_of_the_sphere_equal_all_pairs(spark, radius):
    rng = random.Random(8)
    at = [p for place in PLACES for p in scatter(rng, *place, radius * 4, 40)] + [(90.0, 5.0), (90.0, -120.0), (-90.0, 180.0), (12.0, 180.0), (12.0, -180.0)]
    df = spark.createDataFrame([(f"p{i:03}", *p) for i, p in enumerate(at)], "id string, lat double, lon double").repartition(4)
    want = {(f"p{i:03}", f"p{j:03}"): metres(at[i], at[j]) for i, j in itertools.combinations(range(len(at)), 2)}
    want = {k: m for k, m in want.items() if m <= radius}
    got = cluster.near_pairs(df, radius).collect()
    assert len(got) == len(want) and {(r["id_a"], r["id_b"]) for r in got} == set(want)
    label = {f"p{i:03}": f"p{i:03}" for i in range(len(at))}
    while any(label[a] != label[b] for a, b in want):
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    assert {r["id"]: r["cluster"] for r in cluster.clusters(df, radius).collect()} == label
    assert len(set(label.values())) < len(at) / 3


def test_known_gaps_of_flat_grids(spark):
    rows = [("a", 10.0, 179.9999), ("b", 10.0, -179.9999), ("c", 89.9, 0.0), ("d", 89.9, 0.4), ("e", 89.9, -0.4)]
    df = spark.createDataFrame(rows, "id string, lat double, lon double")
    assert {(r["id_a"], r["id_b"]) for r in cluster.near_pairs(df, 100.0).collect()} == {("a", "b"), ("c", "d"), ("c", "e")}
    assert {r["id"]: r["cluster"] for r in cluster.clusters(df, 100.0).collect()} == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "c"}


def test_one_far_latitude_costs_no_other_point(spark):
    """The cells that the points of a town ask for do not depend on a report near a pole."""
    from pyspark.sql import functions as F

    from hazardmap.operators.sphere import chord, with_cells

    side = chord(150.0) / math.sqrt(2)
    at = lambda rows: with_cells(spark.createDataFrame(rows, "lat double, lon double"), "lat", "lon", 150.0, side, upward=True).groupBy("lat", "lon").count().agg(F.max("count")).first()[0]
    assert at([(26.0 + i / 1000, 92.0) for i in range(50)] + [(0.0, 0.0), (75.0, 179.9999)]) <= 16
    assert at([(89.9, 0.0), (90.0, 0.0), (-89.9999, 3.0), (89.9985, 1.0)]) <= 60


def test_nearest_node_of_the_sphere_equals_all_distances(spark):
    rng = random.Random(9)
    nodes = [p for place in PLACES for p in scatter(rng, *place, 2000, 15)]
    points = [p for place in PLACES for p in scatter(rng, *place, 3000, 12)] + [(45.0, 0.0), (-60.0, 179.0), (90.0, 1.0)]
    named = [(f"n{i:03}", *p) for i, p in enumerate(nodes)]
    df = spark.createDataFrame([(str(i), *p) for i, p in enumerate(points)], "id string, lat double, lon double")
    got = {r["id"]: r for r in nearest.nearest_node(df, spark.createDataFrame(named, "node_id string, lat double, lon double")).collect()}
    assert len(got) == len(points)
    for i, p in enumerate(points):
        best = min(metres(p, q) for q in nodes)
        assert abs(got[str(i)]["metres"] - best) < 1e-3, p


def test_nearest_node_over_the_date_line(spark):
    nodes = spark.createDataFrame([("far", 10.004, 179.99999), ("near", 10.0, -179.99999)], "node_id string, lat double, lon double")
    at = spark.createDataFrame([("x", 10.0, 179.99999)], "id string, lat double, lon double")
    assert nearest.nearest_node(at, nodes).first()["node_id"] == "near"


def test_clusters_of_numbered_cells(spark):
    """No reports, reports without a place, several at one spot; other columns stay; too small a radius is refused."""
    schema = "id string, lat double, lon double, note string"
    rows = [("a", 10.0, 20.0, "x"), ("b", 10.0, 20.0, None), ("c", 10.001, 20.0, "y"), ("d", 10.1, 20.0, "z"), ("e", None, 20.0, "n"), ("f", None, None, None)]
    df = spark.createDataFrame(rows, schema)
    assert {r["id"]: r["cluster"] for r in cluster.clusters(df).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "f"}
    assert {(r["id"], r["note"], r["cluster"]) for r in cluster.labelled(df).collect()} == {("a", "x", "a"), ("b", None, "a"), ("c", "y", "a"), ("d", "z", "d")}
    got = {(r["radius_m"], r["id"], r["cluster"]) for r in cluster.clusters_by_radius(df, [150.0, 50.0, 50.0]).collect()}
    assert got == {(r, i, c) for r, own in ((50.0, "aacd"), (150.0, "aaad")) for i, c in zip("abcd", own)}
    assert cluster.clusters(spark.createDataFrame([], schema)).count() == 0
    with pytest.raises(ValueError):
        cluster.labelled(df, 1e-4)


def test_components_of_repeated_links(spark):
    from hazardmap.operators.components import components

    links = [(i, i + 1) for i in range(0, 60) if i % 10 != 9] * 2 + [(5, 5), (61, 60)]
    df = spark.createDataFrame(links, "a long, b long").repartition(7)
    assert {r["node"]: r["label"] for r in components(df).collect()} == {i: i // 10 * 10 for i in range(62)}
