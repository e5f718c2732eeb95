"""Constants and parameters of every job."""

from __future__ import annotations

from dataclasses import dataclass

EARTH_M = 6_371_000.0
#: Metres of one degree on that sphere, less a margin so that cells never come out too small for a radius.
DEGREE_M = 111_194.0
#: Metres of a degree in the flat plane that segment distances are measured in.
PLANE_DEGREE_M = 111_320.0

# Fixed values of the domain.
WATER_LEVELS = {"ankle": 1, "knee": 2, "waist": 3, "above": 4}
WATER_DEPTH = {"ankle": 0.5, "knee": 1.0, "waist": 2.0, "above": 3.0}
DANGER_NAMES = ("safe", "caution", "restricted", "severe", "red")
DANGER_MEANING = (
    "passable on foot and by vehicle",
    "ankle deep, slow going",
    "knee deep, no vehicles",
    "waist deep, boat only",
    "above waist or rising fast, rescue territory",
)
SPEED_KMH = {"highway": 60.0, "main": 40.0, "residential": 25.0, "track": 12.0, "footpath": 4.0}
ROAD_TYPES = {
    "motorway": "highway",
    "trunk": "highway",
    "primary": "main",
    "secondary": "main",
    "tertiary": "residential",
    "unclassified": "residential",
    "residential": "residential",
    "track": "track",
}


@dataclass(frozen=True)
class Tuning:
    """Thresholds of the danger map and of routing."""

    now_ms: int = 1_735_000_000_000
    radius_m: float = 150.0
    half_life_h: float = 3.0
    confirm: float = 0.55
    draw: float = 0.25
    stale_h: float = 6.0
    cap_one: float = 0.45
    cap_two: float = 0.75
    weight_floor: float = 0.01
    vote_cap: float = 0.95
    lean: float = 0.8
    max_wait_h: float = 24.0
    uncertain_factor: float = 5.0
    walk_kmh: float = 4.0
    other_kmh: float = 25.0
    largest_share: float = 0.90
    tile_nodes: int = 4000
