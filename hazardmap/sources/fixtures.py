"""Inputs derived from the TPC-H-like tables, which have no positions: each view is one SQL text that runs
unchanged in Spark (session time zone UTC) and in other engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VIEWS: dict[str, str] = {
    "reports": """
SELECT
  concat('r', cast(event_id AS string)) AS id,
  CASE WHEN mod(place, 6) = 5 THEN concat('solo', cast(place AS string)) ELSE concat('d', cast(mod(user_id, 6) AS string)) END AS device_id,
  cast(1 AS bigint) AS counter,
  CASE WHEN mod(event_id, 41) = 0 THEN 'aerial' WHEN mod(event_id, 5) = 0 THEN 'responder' ELSE 'volunteer' END AS source,
  CASE WHEN mod(event_id, 97) = 0 THEN NULL ELSE cast(26.0 AS double) + cast(floor(place / 100) AS double) * cast(0.005 AS double) + cast(mod(event_id * 31, 11) AS double) * cast(0.0001 AS double) END AS lat,
  CASE WHEN mod(event_id, 97) = 0 THEN NULL ELSE cast(92.0 AS double) + (CASE WHEN mod(place, 100) < 20 THEN cast(mod(place, 100) AS double) * cast(0.0012 AS double) WHEN mod(place, 100) < 30 THEN cast(0.03 AS double) + cast(mod(place, 100) - 20 AS double) * cast(0.006 AS double) ELSE cast(0.1 AS double) + cast(mod(place, 100) AS double) * cast(0.006 AS double) END) + cast(mod(event_id * 17, 7) AS double) * cast(0.0001 AS double) END AS lon,
  CASE WHEN mod(event_id, 4) = 3 THEN cast(0.6 AS double) ELSE cast(1.0 AS double) END AS location_confidence,
  CASE WHEN event_type = 'view' THEN NULL ELSE cast(floor(value) AS int) END AS people_count,
  CASE WHEN mod(event_id, 19) = 0 THEN 1 ELSE 0 END AS injured,
  CASE WHEN mod(event_id, 3) = 0 THEN 1 ELSE 0 END AS children_elderly,
  CASE WHEN event_type = 'signup' AND mod(event_id, 3) = 0 THEN NULL
       ELSE CASE least(3, mod(place, 4) + (CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)) WHEN 0 THEN 'ankle' WHEN 1 THEN 'knee' WHEN 2 THEN 'waist' ELSE 'above' END END AS water_level,
  CASE WHEN mod(place, 4) >= 2 AND mod(event_id, 4) = 0 THEN 1 ELSE 0 END AS rising,
  CASE WHEN mod(place, 4) >= 2 AND mod(event_id, 3) > 0 THEN 'no' WHEN mod(place, 4) = 0 THEN 'yes' ELSE 'unknown' END AS road_passable,
  CASE WHEN mod(event_id, 7) = 0 THEN cast(0.8 AS double) ELSE cast(0.0 AS double) END AS extraction_confidence,
  cast(1735000000000 AS bigint) - (mod(event_id * 37, 480) + mod(place, 5) * 180) * 60000 AS reported_at,
  cast(1735000000000 AS bigint) - (mod(event_id * 37, 480) + mod(place, 5) * 180) * 60000 AS synced_at
FROM (SELECT *, cast(floor(event_id / 8) AS bigint) AS place FROM events) e
""",
    "edit_log": """
SELECT
  concat('r', cast(cast(floor(event_id / 4) AS bigint) AS string)) AS id,
  concat('d', cast(mod(user_id, 6) AS string)) AS device_id,
  mod(event_id * 7 + user_id, 5) AS counter,
  event_id AS arrival_seq,
  cast(1735000000000 AS bigint) + event_id * 1000 AS arrival_ms,
  cast(1735000000000 AS bigint) + event_id * 1000 - mod(user_id, 9) * 3600000 AS phone_time,
  CASE WHEN event_type = 'view' THEN NULL ELSE cast(floor(value) AS int) END AS people_count,
  CASE event_type WHEN 'click' THEN 'ankle' WHEN 'purchase' THEN 'knee' WHEN 'error' THEN 'waist' WHEN 'signup' THEN 'above' ELSE NULL END AS water_level,
  CASE mod(event_id, 3) WHEN 0 THEN 'yes' WHEN 1 THEN 'no' ELSE 'unknown' END AS road_passable,
  CASE mod(event_id, 5) WHEN 0 THEN '' WHEN 1 THEN 'people_count' WHEN 2 THEN 'water_level' WHEN 3 THEN 'road_passable,people_count' ELSE 'not_a_field' END AS changed_csv
FROM events
""",
    "road_nodes": """
SELECT cast(c_custkey AS string) AS node_id,
  cast(26.0 AS double) + floor(c_custkey / 50) * cast(0.0018 AS double) AS lat,
  cast(92.0 AS double) + mod(c_custkey, 50) * cast(0.002 AS double) AS lon
FROM customer
""",
    "road_edges": """
SELECT least(cast(a AS string), cast(b AS string)) AS a, greatest(cast(a AS string), cast(b AS string)) AS b,
  CASE segment WHEN 'AUTOMOBILE' THEN 'highway' WHEN 'BUILDING' THEN 'main' WHEN 'HOUSEHOLD' THEN 'residential' WHEN 'MACHINERY' THEN 'track' ELSE 'footpath' END AS road_type
FROM (
  SELECT x.c_custkey AS a, y.c_custkey AS b, x.c_mktsegment AS segment FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 WHERE mod(x.c_custkey, 50) < 49
  UNION ALL
  SELECT x.c_custkey AS a, y.c_custkey AS b, x.c_mktsegment AS segment FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 50
) e
""",
    "safe_zones": """
SELECT concat('sz', cast(s_suppkey AS string)) AS id, s_name AS name,
  cast(26.0 AS double) + mod(s_suppkey * 37, 30) * cast(0.0018 AS double) + cast(0.0004 AS double) AS lat,
  cast(92.0 AS double) + mod(s_suppkey * 11, 50) * cast(0.002 AS double) + cast(0.0003 AS double) AS lon,
  cast(floor(abs(s_acctbal) / 100) AS int) AS capacity,
  cast(mod(s_suppkey * 13, 60) AS int) AS occupied,
  CASE WHEN mod(s_suppkey, 10) = 9 THEN 'closed' ELSE 'open' END AS status
FROM supplier
""",
    "incidents": """
SELECT cast(place AS string) AS incident_id,
  cast(26.0 AS double) + cast(floor(place / 100) AS double) * cast(0.005 AS double) + cast(0.0005 AS double) AS lat,
  cast(92.0 AS double) + (CASE WHEN mod(place, 100) < 20 THEN cast(mod(place, 100) AS double) * cast(0.0012 AS double) WHEN mod(place, 100) < 30 THEN cast(0.03 AS double) + cast(mod(place, 100) - 20 AS double) * cast(0.006 AS double) ELSE cast(0.1 AS double) + cast(mod(place, 100) AS double) * cast(0.006 AS double) END) + cast(0.0003 AS double) AS lon,
  CASE mod(place, 4) WHEN 0 THEN 'ankle' WHEN 1 THEN 'knee' WHEN 2 THEN 'waist' ELSE 'above' END AS true_water_level
FROM (SELECT DISTINCT cast(floor(event_id / 8) AS bigint) AS place FROM events) p
""",
    "way_members": """
SELECT l_orderkey AS way_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS pos,
  cast(l_suppkey AS string) AS node_id,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'motorway' WHEN '2-HIGH' THEN 'primary' WHEN '3-MEDIUM' THEN 'tertiary' WHEN '5-LOW' THEN 'track' ELSE 'footway' END AS highway
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
""",
}

_TABLES = ("events", "customer", "supplier", "lineitem", "orders")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables in sf_dir."""
    sql = VIEWS[name]
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES if f" {t} " in f" {sql} ".replace("\n", " ").replace(")", " ")}
    for t in frames:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t}", f"JOIN {{{t}}}")
    return spark.sql(sql, **frames)


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "reports")


def edit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with `changed` as an array."""
    log = view(spark, sf_dir, "edit_log")
    changed = F.when(F.col("changed_csv") == "", F.array().cast("array<string>")).otherwise(F.split("changed_csv", ","))
    return log.withColumn("changed", changed).drop("changed_csv")
