"""The danger map: confidence, level and verdict of each cluster, in two passes around contradicting reports.

Reports are grouped by (cluster, voter) first, so a city-wide cluster shrinks to one row per voter before its rows meet;
from these rows one more grouping gives confidence, support of every level, backers, devices and the centre.  One join
back marks the reports that contradict their cluster and tells how far it spreads.  The second pass reads only clusters
that hold such reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DANGER_NAMES, Tuning
from ..functions import columns as c
from ..sources.shared import keep
from .cluster import clusters, labelled

LEVELS = range(len(DANGER_NAMES))


def weighed(reports: DataFrame, labels: DataFrame, t: Tuning, now: Column | None = None) -> DataFrame:
    """Reports with their cluster, weight, claimed level and voter."""
    return _weighed(reports.join(labels, "id"), t, now)


def _weighed(reports: DataFrame, t: Tuning, now: Column | None = None) -> DataFrame:
    return reports.withColumns({"weight": c.report_weight(t, now), "claim": c.claimed_level(), "voter": c.voter(), "aerial": F.coalesce(F.col("source") == "aerial", F.lit(False))})


def _voters(rows: DataFrame, t: Tuning, keys: list[str]) -> DataFrame:
    """One row per keys and voter: best weight, best weight by claimed level among reports that have a say, flags, counts, sums of positions."""
    scored = F.col("weight") > t.weight_floor
    given = F.coalesce(F.when(F.col("synced_at") != 0, F.col("synced_at")), F.when(F.col("reported_at") != 0, F.col("reported_at")), F.lit(0))
    any_of = lambda x: F.max(x.cast("int"))
    return rows.groupBy(*keys, "voter").agg(
        F.max("weight").alias("vote"),
        *(F.max(F.when(scored & (F.col("claim") == k), F.col("weight"))).alias(f"w{k}") for k in LEVELS),
        any_of(F.col("aerial")).alias("aerial"),
        any_of(scored & (F.coalesce(F.col("rising"), F.lit(0)) != 0)).alias("rising"),
        any_of(scored & (F.coalesce(F.col("road_passable"), F.lit("")) == "no")).alias("cut"),
        F.count("*").alias("reports"),
        any_of(F.col("device_id").isNotNull() & (F.col("device_id") != "")).alias("device"),
        any_of(F.col("device_id").isNull()).alias("no_device"),
        any_of(F.coalesce(F.col("device_id") == "", F.lit(False))).alias("blank_device"),
        F.max(given).alias("newest"),
        F.sum("lat").alias("lats"),
        F.sum("lon").alias("lons"),
    )


def judged(rows: DataFrame, t: Tuning, keys: list[str]) -> DataFrame:
    """One row per keys: confidence, level (null where no report has a say), backers (by level), reports, devices, newest, aerial, centre."""
    by = _voters(rows, t, keys).groupBy(*keys).agg(
        F.count("*").alias("voters"),
        (1 - F.product(1 - F.least("vote", F.lit(t.vote_cap)))).alias("sure"),
        *(F.sum(f"w{k}").alias(f"s{k}") for k in LEVELS),
        F.array(*(F.count(f"w{k}") for k in LEVELS)).alias("backers"),
        *((F.max(k) == 1).alias(k) for k in ("aerial", "rising", "cut")),
        F.sum("reports").alias("reports"),
        (F.sum("device") + F.max("no_device") + F.max("blank_device")).alias("devices"),
        F.max("newest").alias("newest"),
        (F.sum("lats") / F.sum("reports")).alias("clat"),
        (F.sum("lons") / F.sum("reports")).alias("clon"),
    )
    capped = F.when(F.col("aerial"), F.col("sure")).when(F.col("voters") == 1, F.least("sure", F.lit(t.cap_one))).when(F.col("voters") == 2, F.least("sure", F.lit(t.cap_two))).otherwise(F.col("sure"))
    most = F.greatest(*(F.col(f"s{k}") for k in LEVELS))
    base = F.coalesce(*(F.when(F.col(f"s{k}") >= t.lean * most, F.lit(k)) for k in reversed(LEVELS)))
    up = F.when(F.col("rising"), F.least(base + 1, F.lit(LEVELS[-1]))).otherwise(base)
    level = F.when(base.isNotNull(), F.when(F.col("cut"), F.greatest(up, F.lit(2))).otherwise(up))
    return by.select(*keys, F.round(capped, 3).alias("confidence"), level.alias("level"), "voters", "backers", "reports", "devices", "newest", "aerial", "clat", "clon")


def confidence(rows: DataFrame, t: Tuning, keys: list[str]) -> DataFrame:
    """keys, confidence and voters: best vote of each voter, chance that at least one is right, capped for one or two voters."""
    return judged(rows, t, keys).select(*keys, "confidence", "voters")


def level(rows: DataFrame, t: Tuning, keys: list[str]) -> DataFrame:
    """keys and level: the worst level with nearly the best support, one up where water rises, two at least where a road is cut."""
    return judged(rows, t, keys).where(F.col("level").isNotNull()).select(*keys, "level")


def _marked(rows: DataFrame, t: Tuning) -> tuple[DataFrame, DataFrame]:
    """The first pass by cluster, and rows with against (contradicts a sure cluster), distance to the centre, and what the cluster says."""
    first = keep(judged(rows, t, ["cluster"]).withColumn("level", F.coalesce("level", F.lit(0))), "judged")
    says = first.select("cluster", F.col("level").alias("group_level"), F.col("confidence").alias("group_confidence"), "backers", F.col("reports").alias("of"), "clat", "clon")
    majority = F.element_at("backers", F.col("group_level") + 1)
    alone = ~F.col("aerial") & (F.col("of") >= 2) & (F.col("group_confidence") >= t.confirm) & (F.abs(F.col("claim") - F.col("group_level")) >= 2) & (F.element_at("backers", F.col("claim") + 1) < majority)
    met = rows.join(says, "cluster").withColumns({"against": alone, "group_voters": majority, "far": c.haversine_m(F.col("clat"), F.col("clon"), F.col("lat"), F.col("lon"))})
    return first, met.drop("backers", "of", "clat", "clon")


def contradictions(rows: DataFrame, t: Tuning) -> DataFrame:
    """Reports that stand alone against a sure cluster: id, cluster, claim, group_level, group_confidence, group_voters."""
    return _marked(rows, t)[1].where("against").select("id", "cluster", "claim", "group_level", "group_confidence", "group_voters")


def held_reports(rows: DataFrame, reports: DataFrame, t: Tuning) -> DataFrame:
    """Reports held for review: those that contradict their cluster and those without a place."""
    against = contradictions(rows, t).select(
        F.col("id").alias("report_id"),
        c.danger_name(F.col("claim")).alias("claims"),
        c.danger_name(F.col("group_level")).alias("group_says"),
        "group_confidence",
        F.concat(F.lit("reports "), c.danger_name(F.col("claim")), F.lit(", but "), F.col("group_voters").cast("string"), F.lit(" other devices here agree on "), c.danger_name(F.col("group_level"))).alias("reason"),
    )
    nowhere = reports.where(~c.located()).select(
        F.col("id").alias("report_id"), F.lit(None).cast("string").alias("claims"), F.lit(None).cast("string").alias("group_says"), F.lit(0.0).alias("group_confidence"), F.lit("no usable location").alias("reason")
    )
    return against.unionByName(nowhere)


def zone_geometry(rows: DataFrame, t: Tuning) -> DataFrame:
    """cluster, lat, lon, radius_m: mean of its located reports, held ones too, and how far they spread plus the radius."""
    first, marked = _marked(rows, t)
    far = marked.groupBy("cluster").agg(F.max("far").alias("far"))
    return first.join(far, "cluster").select("cluster", F.col("clat").alias("lat"), F.col("clon").alias("lon"), _radius(t).alias("radius_m"))


def _radius(t: Tuning) -> Column:
    return F.when(F.col("reports") == 1, F.lit(t.radius_m)).otherwise(F.round(F.col("far") + t.radius_m, 1))


def all_zones(rows: DataFrame, t: Tuning, with_ids: bool = False) -> DataFrame:
    """One row per cluster, drawn or not.

    with_ids gathers the report ids of each cluster in one row, for maps of clusters of a bounded size; the bridge table
    of zone_members() has them for clusters of any size.
    """
    first, marked = _marked(rows, t)
    ids = [F.sort_array(F.collect_list(F.when(~F.col("against"), F.col("id")))).alias("report_ids")] if with_ids else []
    spread = keep(marked.groupBy("cluster").agg(F.max("far").alias("far"), F.count_if("against").alias("held_count"), *ids), "spread")
    touched = spread.where(F.col("held_count") > 0).select("cluster")
    again = judged(marked.where(~F.col("against")).join(touched, "cluster", "left_semi"), t, ["cluster"])
    first = first.join(spread, "cluster")
    changed = ["confidence", "level", "reports", "devices", "newest", "aerial"]
    second = again.select("cluster", *(F.col(k).alias(f"new_{k}") for k in changed), F.lit(True).alias("again"))
    # a held report never stands alone in its cluster, so every touched cluster comes again
    joined = first.withColumn("radius_m", _radius(t)).join(second, "cluster", "left").select("cluster", "radius_m", "held_count", F.col("clat").alias("lat"), F.col("clon").alias("lon"), *(["report_ids"] if with_ids else []), *(F.when(F.col("again"), F.col(f"new_{k}")).otherwise(F.col(k)).alias(k) for k in changed))
    joined = joined.withColumn("level", F.coalesce("level", F.lit(0)))
    age = F.greatest(F.lit(0.0), (F.lit(t.now_ms) - F.col("newest")) / 3_600_000.0)
    verdict = F.when((F.col("confidence") < t.draw) | (F.col("level") == 0), "ignore").when((F.col("confidence") >= t.confirm) & (F.col("age") <= t.stale_h), "block").otherwise("expensive")
    evidence = F.concat(
        F.col("reports").cast("string"), F.lit(" reports from "), F.col("devices").cast("string"), F.lit(" devices, newest "), F.round("age", 1).cast("string"), F.lit(" h ago"),
        F.when(F.col("held_count") > 0, F.concat(F.lit(", "), F.col("held_count").cast("string"), F.lit(" held"))).otherwise(""),
    )
    return joined.withColumn("age", age).select(
        F.concat(F.lit("z-"), F.col("cluster")).alias("cluster_id"),
        "lat",
        "lon",
        "radius_m",
        F.col("level").alias("danger"),
        c.danger_name(F.col("level")).alias("danger_name"),
        c.danger_meaning(F.col("level")).alias("meaning"),
        "confidence",
        F.col("reports").alias("report_count"),
        F.col("devices").cast("long").alias("device_count"),
        "held_count",
        F.col("aerial").alias("has_aerial"),
        F.round("age", 2).alias("newest_age_hours"),
        verdict.alias("routing"),
        *(["report_ids"] if with_ids else []),
        evidence.alias("evidence"),
    )


def drawn(zones: DataFrame, t: Tuning) -> DataFrame:
    return zones.where((F.col("confidence") >= t.draw) & (F.col("danger") > 0))


def zone_members(rows: DataFrame, t: Tuning) -> DataFrame:
    """(cluster_id, report_id) of supporting reports: the bridge table for clusters of any size."""
    return _marked(rows, t)[1].where(~F.col("against")).select(F.concat(F.lit("z-"), F.col("cluster")).alias("cluster_id"), F.col("id").alias("report_id"))


def placed(reports: DataFrame, t: Tuning) -> DataFrame:
    """Located reports, weighed, with their clusters; written once, as many steps read them."""
    here = reports.where(c.located())
    return keep(_weighed(labelled(here, t.radius_m), t), "placed")


def danger_zones(reports: DataFrame, t: Tuning = Tuning(), with_ids: bool = False) -> DataFrame:
    """The zones to draw, worst and surest first; with_ids as of all_zones().  Written before they are sorted: a sort reads its rows twice."""
    return keep(drawn(all_zones(placed(reports, t), t, with_ids), t), "zones").orderBy(F.desc("danger"), F.desc("confidence"), "cluster_id")


def map_stats(reports: DataFrame, t: Tuning = Tuning()) -> DataFrame:
    """One row: reports, clusters, zones drawn, blocked and expensive ones, reports held."""
    rows = placed(reports, t)
    zones = drawn(all_zones(rows, t, with_ids=False), t).agg(
        F.count("*").alias("zones_drawn"), F.count_if(F.col("routing") == "block").alias("blocked"), F.count_if(F.col("routing") == "expensive").alias("expensive")
    )
    counts = reports.agg(F.count("*").alias("reports"), F.count_if(~c.located()).alias("alone"))
    groups = rows.select("cluster").distinct().agg(F.count("*").alias("groups"))
    held = held_reports(rows, reports, t).agg(F.count("*").alias("held_for_review"))
    one = counts.crossJoin(groups).crossJoin(zones).crossJoin(held)  # one row each
    return one.select("reports", (F.col("groups") + F.col("alone")).alias("clusters"), "zones_drawn", "blocked", "expensive", "held_for_review")


def decay_curve(reports: DataFrame, hours: list[float], t: Tuning = Tuning()) -> DataFrame:
    """cluster, hours, confidence and level as the clock runs on without new reports; clusters are found once."""
    here = reports.where(c.located())
    labels = clusters(here, t.radius_m)
    instants = F.broadcast(reports.sparkSession.createDataFrame([(float(h), int(t.now_ms + h * 3_600_000)) for h in hours], "hours double, now_ms long"))
    rows = weighed(here.crossJoin(instants), labels, t, F.col("now_ms"))
    keys = ["cluster", "hours"]
    return judged(rows, t, keys).select(*keys, "confidence", F.coalesce("level", F.lit(0)).alias("danger"))
