"""Readers and writers of reports, shelters and road data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REPORT = (
    "id string, device_id string, counter bigint, phone_time bigint, source string, text string, photo_ids array<string>, lat double, lon double, "
    "polygon array<array<double>>, location_confidence double, people_count int, injured int, children_elderly int, water_level string, rising int, "
    "road_passable string, extraction_confidence double, severity double, override_by string, override_reason string, status string, cluster_id string, "
    "reported_at bigint, synced_at bigint, updated_at bigint"
)
UPLOAD = (
    "reports array<struct<id:string,device_id:string,counter:bigint,phone_time:bigint,source:string,text:string,photo_ids:array<string>,lat:double,lon:double,"
    "polygon:array<array<double>>,location_confidence:double,people_count:int,injured:int,children_elderly:int,water_level:string,rising:int,road_passable:string,"
    "extraction_confidence:double,changed:array<string>>>, last_cursor bigint"
)
ELEMENT = "type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>"
OSM = "elements array<struct<type:string,id:bigint,lat:double,lon:double,nodes:array<bigint>,tags:map<string,string>>>"
SAFE_ZONE = ("id string, name string, lat double, lon double, capacity int, occupied int, status string")

#: Values of fields that an upload may leave out.
DEFAULTS = {"counter": 0, "source": "volunteer", "text": "", "location_confidence": 1.0, "injured": 0, "children_elderly": 0, "rising": 0, "road_passable": "unknown", "extraction_confidence": 0.0}


BAD = "_corrupt_record"


def _parsed(lines: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """JSON lines (column value) as objects of a schema, and the lines that are none of it as they stand; blank lines are neither."""
    lines = lines.where(F.trim("value") != "")
    read = lines.select("value", F.from_json("value", f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("o"))
    good = F.col("o").isNotNull() & F.col(f"o.{BAD}").isNull()
    return read.where(good).select("o.*").drop(BAD), read.where(~good).select("value")


def _typed(uploads: DataFrame) -> DataFrame:
    rows = uploads.select(F.explode("reports").alias("r")).select("r.*")
    blank = F.when(F.col("water_level") != "", F.col("water_level"))  # an empty choice is none
    return rows.fillna(DEFAULTS).withColumns({"water_level": blank, "photo_ids": F.coalesce("photo_ids", F.array().cast("array<string>")), "changed": F.coalesce("changed", F.array().cast("array<string>"))})


def read_edit_log(spark: SparkSession, path: str) -> DataFrame:
    """Uploads ({reports: [...], last_cursor}, one JSON object a line) as one row per report, with defaults filled in."""
    return _typed(spark.read.schema(UPLOAD).json(path))


def read_uploads(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """As read_edit_log(), and beside it the quarantine: lines that are no upload (column value)."""
    good, bad = _parsed(spark.read.text(path), UPLOAD)
    return _typed(good), bad


def encode_uploads(rows: DataFrame, upload: str = "upload") -> DataFrame:
    """JSON lines (column value), one for each upload (a column that numbers the batches that phones send): {reports: [...], last_cursor}."""
    known = set(rows.columns)
    report = next(f.dataType.elementType for f in T._parse_datatype_string(UPLOAD) if f.name == "reports")
    fields = [F.col(f.name) if f.name in known else F.lit(None).cast(f.dataType).alias(f.name) for f in report]
    each = rows.groupBy(upload).agg(F.sort_array(F.collect_list(F.struct("arrival_seq", F.struct(*fields).alias("r")))).alias("x"), F.max("arrival_seq").alias("last_cursor"))  # what one phone sends at once
    return each.select(F.to_json(F.struct(F.col("x.r").alias("reports"), "last_cursor")).alias("value"))


def stream_edit_log(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream of files."""
    return _typed(spark.readStream.schema(UPLOAD).json(path))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).parquet(path)


def read_safe_zones(spark: SparkSession, path: str) -> DataFrame:
    """Shelters from CSV (with a header) or Parquet."""
    reader = spark.read.schema(SAFE_ZONE)
    return reader.csv(path, header=True) if path.rstrip("/").endswith(".csv") else reader.parquet(path)


def read_osm(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes (node_id, lat, lon) and way members (way_id, pos, node_id, highway) of an OSM JSON extract."""
    return _elements(spark.read.schema(OSM).json(path, multiLine=True).select(F.explode("elements").alias("e")).select("e.*"))


def read_osm_lines(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes and way members of files with one element a line, which are read in pieces, and the lines that are none (column value)."""
    good, bad = _parsed(spark.read.text(path), ELEMENT)
    return *_elements(good), bad


def encode_osm(nodes: DataFrame, members: DataFrame) -> DataFrame:
    """Nodes and ways as JSON lines (column value), one element a line."""
    node = nodes.select(F.to_json(F.struct(F.lit("node").alias("type"), F.col("node_id").cast("bigint").alias("id"), "lat", "lon")).alias("value"))
    way = members.groupBy("way_id", "highway").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("m"))  # a way's length is bounded
    refs = F.transform("m", lambda x: x["node_id"].cast("bigint"))
    tags = F.when(F.col("highway").isNotNull(), F.create_map(F.lit("highway"), F.col("highway")))
    return node.unionByName(way.select(F.to_json(F.struct(F.lit("way").alias("type"), F.col("way_id").cast("bigint").alias("id"), refs.alias("nodes"), tags.alias("tags"))).alias("value")))


def _elements(element: DataFrame) -> tuple[DataFrame, DataFrame]:
    nodes = element.where(F.col("type") == "node").select(F.col("id").cast("string").alias("node_id"), "lat", "lon")
    ways = element.where(F.col("type") == "way").select(F.col("id").alias("way_id"), F.posexplode("nodes").alias("pos", "node"), F.col("tags")["highway"].alias("highway"))
    return nodes, ways.select("way_id", F.col("pos").cast("bigint").alias("pos"), F.col("node").cast("string").alias("node_id"), "highway")


def decode_json(rows: DataFrame) -> DataFrame:
    """Text columns photo_ids and polygon with their decoded forms beside them; malformed text decodes to null and stays as it was."""
    return rows.withColumns({"photos": F.from_json("photo_ids", "array<string>"), "outline": F.from_json("polygon", "array<array<double>>")})


def encode_json(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"photo_ids": F.to_json("photo_ids"), "polygon": F.to_json("polygon")})


def write_snapshot(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """Replaces a snapshot; with by, only the partitions that df has rows of, so that the files of all others stay."""
    writer = df.write.mode("overwrite")
    (writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by) if by else writer).parquet(path)


def write_by_id(df: DataFrame, path: str, id_column: str = "id", group_bytes: int = 16 << 20) -> None:
    """Replaces a snapshot that look_up() reads: files by ranges of the id, rows sorted by it, row groups with a bloom filter."""
    rows = df.repartitionByRange(id_column).sortWithinPartitions(id_column)
    rows.write.mode("overwrite").option(f"parquet.bloom.filter.enabled#{id_column}", "true").option("parquet.block.size", str(group_bytes)).parquet(path)


def look_up(spark: SparkSession, path: str, ids: list[str], id_column: str = "id") -> DataFrame:
    """Rows of some ids; the condition goes to the reader, which passes over row groups by their ranges and bloom filters."""
    return spark.read.parquet(path).where(F.col(id_column).isin(ids))


def append_changes(df: DataFrame, path: str) -> None:
    """Adds rows to a delta feed."""
    df.write.mode("append").parquet(path)


def reset(spark: SparkSession, path: str, schema: str = REPORT) -> None:
    """An empty snapshot of the schema."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
