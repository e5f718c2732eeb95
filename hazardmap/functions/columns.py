"""Column expressions of the domain; none needs a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DANGER_MEANING, DANGER_NAMES, EARTH_M, PLANE_DEGREE_M, SPEED_KMH, WATER_DEPTH, WATER_LEVELS, Tuning


def lookup(key: Column, table: dict, default=None) -> Column:
    """table[key], or the default; unknown and null keys are no error."""
    out = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[key]
    return out if default is None else F.coalesce(out, F.lit(default))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def segment_distance_m(alat: Column, alon: Column, blat: Column, blon: Column, lat: Column, lon: Column) -> Column:
    """Metres from a point to the nearest point of segment a-b, on a plane at the point's latitude."""
    scale = PLANE_DEGREE_M * F.cos(F.radians(lat))
    ax, ay, bx, by = (alon - lon) * scale, (alat - lat) * PLANE_DEGREE_M, (blon - lon) * scale, (blat - lat) * PLANE_DEGREE_M
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / F.when(length2 > 0, length2)))
    return F.when(length2 == 0, F.hypot(ax, ay)).otherwise(F.hypot(ax + t * dx, ay + t * dy))


def _given(value: Column) -> Column:
    """A time of 0 is as good as none."""
    return F.when(value != 0, value)


def _flag(value: Column) -> Column:
    return F.coalesce(value, F.lit(0)) != 0


def hours_waiting(t: Tuning) -> Column:
    now = F.lit(t.now_ms)
    reported, seen = F.coalesce(_given(F.col("reported_at")), now), F.coalesce(_given(F.col("synced_at")), now)
    hours = (now - F.greatest(reported, F.least(seen, now))) / 3_600_000.0
    return F.greatest(F.lit(0.0), F.least(hours, F.lit(t.max_wait_h)))


def _people() -> Column:
    return F.greatest(F.coalesce(F.col("people_count"), F.lit(0)), F.lit(0))


def severity(t: Tuning) -> Column:
    """Urgency: injured, vulnerable, number of people (log), rising, cut off, depth, hours waited."""
    add = lambda cond, x: F.when(cond, x).otherwise(0.0)
    return F.round(
        add(_flag(F.col("injured")), 3.0)
        + add(_flag(F.col("children_elderly")), 2.0)
        + 1.5 * F.log1p(_people().cast("double"))
        + add(_flag(F.col("rising")), 2.0)
        + add(F.coalesce(F.col("road_passable"), F.lit("")) == "no", 2.0)
        + lookup(F.col("water_level"), WATER_DEPTH, 0.0)
        + hours_waiting(t),
        2,
    )


def reasons(t: Tuning) -> Column:
    """The terms of the severity as text, in order, only those that apply."""
    wait = hours_waiting(t)
    text = lambda x, digits: F.round(x, digits).cast("string")
    depth = lookup(F.col("water_level"), WATER_DEPTH, 0.0)
    return F.array_compact(
        F.array(
            F.when(_flag(F.col("injured")), F.lit("injured present +3.0")),
            F.when(_flag(F.col("children_elderly")), F.lit("children or elderly +2.0")),
            F.when(_people() > 0, F.concat(_people().cast("string"), F.lit(" people +"), text(1.5 * F.log1p(_people().cast("double")), 2))),
            F.when(_flag(F.col("rising")), F.lit("water rising +2.0")),
            F.when(F.col("road_passable") == "no", F.lit("road cut off +2.0")),
            F.when(depth > 0, F.concat(F.col("water_level"), F.lit(" deep +"), depth.cast("string"))),
            F.when(wait > 0.05, F.concat(F.lit("waiting "), text(wait, 1), F.lit(" h +"), text(wait, 2))),
        )
    )


def report_weight(t: Tuning, now: Column | None = None) -> Column:
    """What one report is worth now: source, age on a half-life curve, sureness of place and of extraction."""
    now = F.lit(t.now_ms) if now is None else now
    seen = F.coalesce(_given(F.col("synced_at")), _given(F.col("reported_at")), now)
    hours = F.greatest(F.lit(0.0), (now - seen) / 3_600_000.0)
    clamp = lambda x, lo: F.greatest(F.lit(lo), F.least(F.lit(1.0), x))
    place = F.when(F.col("location_confidence").isNull(), 1.0).otherwise(clamp(F.col("location_confidence"), 0.2))
    sure = F.when(F.coalesce(F.col("extraction_confidence"), F.lit(0.0)) == 0.0, 1.0).otherwise(clamp(F.col("extraction_confidence"), 0.3))
    return F.when(F.col("source") == "aerial", 1.0).otherwise(0.7) * F.pow(F.lit(0.5), hours / t.half_life_h) * place * sure


def claimed_level() -> Column:
    return lookup(F.col("water_level"), WATER_LEVELS, 0)


def voter() -> Column:
    return F.coalesce(F.when(F.col("device_id") != "", F.col("device_id")), F.col("id"))


def danger_name(level: Column) -> Column:
    return F.array(*(F.lit(x) for x in DANGER_NAMES))[level]


def danger_meaning(level: Column) -> Column:
    return F.array(*(F.lit(x) for x in DANGER_MEANING))[level]


def travel_seconds(length: Column, road_type: Column, mode: str = "drive", t: Tuning = Tuning()) -> Column:
    """Seconds to pass an edge; on foot every road is walked at one speed."""
    kmh = F.lit(t.walk_kmh) if mode == "walk" else lookup(road_type, SPEED_KMH, t.other_kmh)
    return length / (kmh * 1000.0 / 3600.0)


def location_confidence(accuracy_m: Column) -> Column:
    """Sureness of a position fix: under 50 m is full."""
    return F.when(accuracy_m < 50, 1.0).otherwise(0.6)


def located() -> Column:
    return F.col("lat").isNotNull() & F.col("lon").isNotNull()
