"""Cells on the whole sphere, poles and the date line included.

Rows are bands of latitude of one height.  Each row is cut into its own whole number of columns, just so many that none
is wider than the side; columns count round the earth, so the last one of a row stands beside the first.  A circle's
cells follow from its own latitude: in each row it reaches the columns within its span of longitude, all of them where
it holds a pole.  Nothing depends on the extent of a table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EARTH_M

SLACK = 1e-9


def chord(radius_m: float) -> float:
    """Side of the unit sphere's chord of an arc; a cell whose sides, squared and summed, are at most its square has no two points farther apart."""
    return 2 * math.sin(min(radius_m / EARTH_M, math.pi) / 2)


def _row(lat: Column, side: float) -> Column:
    return F.floor((F.radians(lat) + math.pi / 2) / side)


def _columns(y: Column, side: float) -> Column:
    """Columns of row y: as many as its widest parallel needs."""
    widest = F.greatest(F.lit(0.0), F.abs((y + 0.5) * side - math.pi / 2) - side / 2)
    return F.greatest(F.lit(1), F.ceil(F.cos(widest) * (2 * math.pi / side))).cast("long")


def _turn(lon: Column) -> Column:
    """Longitude as a share of the way round."""
    share = F.radians(lon) / (2 * math.pi) + 0.5
    return share - F.floor(share)


def cell(lat: Column, lon: Column, side: float) -> dict[str, Column]:
    """Columns y and x of the cell of a position; side in radians."""
    y = _row(lat, side)
    n = _columns(y, side)
    return {"y": y, "x": F.least(F.floor(_turn(lon) * n), n - 1)}


def with_cells(rows: DataFrame, lat: str, lon: str, radius_m: float, side: float, upward: bool = False) -> DataFrame:
    """A copy of each row for every cell (y, x) that may hold positions within radius_m of it; upward: of its own row of cells and those north of it only.

    Rows first, then the columns of each: plain expressions, so all of it is compiled code.
    """
    radius = radius_m / EARTH_M * (1 + SLACK) + 1e-12
    reach = math.ceil(radius / side)
    polar = F.abs(F.radians(lat)) + radius >= math.pi / 2
    span = F.when(polar, F.lit(1.0)).otherwise(F.asin(F.least(F.lit(1.0), F.sin(F.lit(min(radius, math.pi / 2))) / F.cos(F.radians(lat)))) / (2 * math.pi) * (1 + SLACK) + 1e-12)
    own = [F.col(c) for c in rows.columns]
    at = rows.select(*own, _row(F.col(lat), side).alias("__row"), span.alias("__span"), _turn(F.col(lon)).alias("__turn"), F.explode(F.array(*(F.lit(dy) for dy in range(0 if upward else -reach, reach + 1)))).alias("__dy"))
    at = at.select(*own, "__span", "__turn", (F.col("__row") + F.col("__dy")).alias("y")).where(F.col("y").between(0, math.floor(math.pi / side)))
    at = at.withColumn("__n", _columns(F.col("y"), side))
    at = at.withColumns({"__lo": F.floor((F.col("__turn") - F.col("__span")) * F.col("__n")), "__hi": F.floor((F.col("__turn") + F.col("__span")) * F.col("__n"))})
    all_round = F.col("__hi") - F.col("__lo") + 1 >= F.col("__n")
    x = F.explode(F.sequence(F.when(all_round, F.lit(0).cast("long")).otherwise(F.col("__lo")), F.when(all_round, F.col("__n") - 1).otherwise(F.col("__hi"))))
    return at.select(*own, "y", "__n", x.alias("__x")).select(*own, "y", F.pmod("__x", "__n").alias("x"))
