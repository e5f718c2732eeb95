"""Distance joins and single-link clusters of reports.

Positions are put in cells of the sphere, and each asks for the cells that its circle reaches in its own row and north
of it, so the join is an equi-join on cells with an exact test after it, over the date line and the poles too.  For
clusters, cells without two points farther apart than the radius are contracted first: all reports of one belong
together, so a crowded place costs its distinct positions and not their pairs, and what is chained are numbered cells,
not reports.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import EARTH_M
from ..functions.columns import haversine_m, located
from ..sources.shared import keep
from .components import components
from .sphere import SLACK, cell, chord, with_cells


def near_pairs(points: DataFrame, radius_m: float) -> DataFrame:
    """(id_a, id_b, metres) of located points at most radius_m apart, each pair once with id_a < id_b."""
    side = radius_m / EARTH_M
    points = points.where(located()).select("id", "lat", "lon")
    cells = points.withColumns(cell(F.col("lat"), F.col("lon"), side))
    ask = with_cells(cells.select(F.col("id").alias("id1"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1"), F.col("y").alias("home")), "lat1", "lon1", radius_m, side, upward=True)
    metres = haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon"))
    met = ask.join(cells, ["y", "x"]).where((F.col("y") > F.col("home")) | (F.col("id1") < F.col("id"))).withColumn("metres", metres).where(F.col("metres") <= radius_m)
    return met.select(F.least("id1", "id").alias("id_a"), F.greatest("id1", "id").alias("id_b"), "metres")


def _side(radius_m: float) -> float:
    return chord(radius_m) / math.sqrt(2) * (1 - SLACK)


def cell_links(spots: DataFrame, name: str, radius_m: float) -> DataFrame:
    """Edges (a, b) between the names of different cells that hold two spots (y, x, lat, lon, name) within the radius."""
    ask = with_cells(spots.select(F.col(name).alias("a"), F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), "lat1", "lon1", radius_m, _side(radius_m), upward=True)
    met = ask.join(spots.withColumnRenamed(name, "b"), ["y", "x"]).where(F.col("a") != F.col("b"))
    return met.where(haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon")) <= radius_m).select("a", "b").distinct()


def _row_width(side: float) -> int:
    return math.ceil(2 * math.pi / side) + 1


def cell_numbers(radius_m: float) -> int:
    """How many numbers the contracted cells of a radius take."""
    side = _side(radius_m)
    return (math.floor(math.pi / side) + 2) * _row_width(side)


def _numbered(points: DataFrame, radius_m: float, first: int = 0) -> DataFrame:
    """Located points with y and x of their contracted cell and its number, from first on."""
    side = _side(radius_m)
    return points.withColumns(cell(F.col("lat"), F.col("lon"), side)).withColumn("cell", F.col("y") * _row_width(side) + F.col("x") + first)


def _cell_clusters(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, cluster): links (a, b) chain cells, a cluster is named by the least id in all of its cells.

    The graph is one of occupied cells, whose numbers are longs; reports meet it once, when each takes its cell's cluster.
    """
    homes = cells.groupBy("cell").agg(F.min("id").alias("least"))
    parts = keep(homes.join(components(links), F.col("cell") == F.col("node"), "left").select("cell", "least", F.coalesce("label", "cell").alias("part")), "parts")
    return parts.join(parts.groupBy("part").agg(F.min("least").alias("cluster")), "part").select("cell", "cluster")


def _enough_numbers(n: int) -> None:
    if n >= 2**63:
        raise ValueError("radius too small: the earth has more cells than numbers")


def labelled(reports: DataFrame, radius_m: float = 150.0) -> DataFrame:
    """Located reports with their cluster, chained by links of at most radius_m.

    A cluster is named by its least report id, so neither order nor partitioning changes it.
    """
    _enough_numbers(cell_numbers(radius_m))
    own = reports.where(located())
    cells = keep(_numbered(own, radius_m), "numbered")  # read by each of the steps below, with the columns that it needs
    links = cell_links(cells.select("y", "x", "cell", "lat", "lon").distinct(), "cell", radius_m)
    return cells.join(_cell_clusters(cells, links), "cell").select(*own.columns, "cluster")


def clusters(reports: DataFrame, radius_m: float = 150.0) -> DataFrame:
    """(id, cluster) of every report: located ones as of labelled(), the others each alone."""
    alone = reports.where(~located()).select("id", F.col("id").alias("cluster"))
    return labelled(reports.select("id", "lat", "lon"), radius_m).select("id", "cluster").unionByName(alone)


def clusters_by_radius(reports: DataFrame, radii: list[float]) -> DataFrame:
    """(radius_m, id, cluster) of located reports for several radii: crowded places are contracted for each, components are found once."""
    points = reports.where(located()).select("id", "lat", "lon")
    radii = sorted({float(r) for r in radii})
    sizes = [cell_numbers(r) for r in radii]
    _enough_numbers(sum(sizes))
    each = [_numbered(points, r, sum(sizes[:i])).withColumn("radius_m", F.lit(r)) for i, r in enumerate(radii)]
    links = reduce(DataFrame.unionByName, (cell_links(cells.select("y", "x", "cell", "lat", "lon").distinct(), "cell", r) for r, cells in zip(radii, each)))
    cells = reduce(DataFrame.unionByName, each).select("radius_m", "id", "cell")
    return cells.join(_cell_clusters(cells, links), "cell").select("radius_m", "id", "cluster")
