"""Clusters kept up to date: only reports of clusters that lost one, and those that are new, are linked again.

The state holds a row a located report: id, lat, lon, cluster.  Other clusters stay as they are and take part as one
node each, so a tick costs what moved and the places round it, not the pairs of the whole map.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Tuning
from ..functions.columns import haversine_m, located
from ..sources.shared import keep
from .cluster import cell_links
from .components import components
from .danger import all_zones, drawn, weighed
from .sphere import SLACK, cell, chord, with_cells

STATE = ["id", "lat", "lon", "cluster"]


def advance(state: DataFrame | None, added: DataFrame, removed: DataFrame | None = None, radius_m: float = 150.0) -> DataFrame:
    """The state after reports came (added: id, lat, lon, an id once; one that the state holds has moved) and went (removed: id).

    The same as clustering all reports anew, names included.  Rows without a place are not in the state.
    """
    gone = added.select("id") if removed is None else added.select("id").unionByName(removed.select("id"))
    added = added.where(located()).select("id", "lat", "lon")
    if state is None:
        loose, stays = keep(added, "loose"), None
    else:
        hurt = keep(state.join(gone, "id", "left_semi").select("cluster").distinct(), "hurt")
        if hurt.isEmpty():
            loose, stays = keep(added, "loose"), state.select(*STATE)
        else:
            stays = keep(state.join(hurt, "cluster", "left_anti").select(*STATE), "stays")
            loose = keep(state.join(hurt, "cluster", "left_semi").join(gone, "id", "left_anti").select("id", "lat", "lon").unionByName(added), "loose")
    side = chord(radius_m) / math.sqrt(2) * (1 - SLACK)
    cells = loose.withColumns(cell(F.col("lat"), F.col("lon"), side))
    homes = keep(cells.groupBy("y", "x").agg(F.min("id").alias("home")), "homes")
    spots = keep(cells.select("y", "x", "lat", "lon").distinct().join(homes, ["y", "x"]), "spots")  # reports of a place count once
    links = cell_links(spots, "home", radius_m)
    if stays is not None:
        old = stays.select("lat", "lon", "cluster").distinct().withColumns(cell(F.col("lat"), F.col("lon"), side))
        ask = with_cells(spots.select("home", F.col("lat").alias("lat1"), F.col("lon").alias("lon1")), "lat1", "lon1", radius_m, side)
        near = ask.join(old, ["y", "x"]).where(haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat"), F.col("lon")) <= radius_m)
        links = links.unionByName(near.select(F.col("home").alias("a"), F.col("cluster").alias("b")).distinct())
    labels = keep(components(links), "labels")
    named = homes.join(labels, F.col("home") == F.col("node"), "left").select("y", "x", F.coalesce("label", "home").alias("cluster"))
    out = cells.join(named, ["y", "x"]).select(*STATE)
    if stays is not None:
        out = out.unionByName(stays.join(labels, F.col("cluster") == F.col("node"), "left").select("id", "lat", "lon", F.coalesce("label", "cluster").alias("cluster")))
    return keep(out, "state")


def zones_now(reports: DataFrame, state: DataFrame, t: Tuning) -> DataFrame:
    """The zones to draw as of t.now_ms: clusters from the state, weights always anew."""
    return drawn(all_zones(keep(weighed(reports.where(located()), state.select("id", "cluster"), t), "placed"), t), t)
