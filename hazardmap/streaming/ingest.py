"""Uploads and the live map as streams.

Uploads are merged by keyed state: the state store holds the merged row of each id, so every micro-batch touches only the ids
that it brings, and a restart goes on where the checkpoint ends.  What moved is appended to a feed of files, written
exactly once; the newest row of an id in the feed is its merged report, and further streams read the feed with
checkpoints of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import IntegralType, StructType

from ..config import Tuning
from ..functions.columns import severity
from ..operators import live
from ..operators.merge import IDENTITY
from ..sources.fixtures import VIEWS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def merged_schema(log: DataFrame, fields: list[str]) -> StructType:
    """Columns of merged reports, as of merge_reports()."""
    kinds = {f.name: f.dataType.simpleString() for f in log.schema}
    names = {"id": kinds["id"], **{f: kinds[f] for f in IDENTITY}, **{f: kinds[f] for f in fields}, "counter": "bigint", "reported_at": "bigint", "synced_at": "bigint", "updated_at": "bigint"}
    return StructType.fromDDL(", ".join(f"`{n}` {k}" for n, k in names.items()))


def _plain(value, whole: bool):
    """A value of a pandas frame as a Python one; NaN is none."""
    if value is None or isinstance(value, (float, np.floating)) and np.isnan(value):
        return None
    if isinstance(value, np.ndarray):
        return [_plain(v, False) for v in value]
    value = value.item() if isinstance(value, np.generic) else value
    return int(value) if whole else value


class Merge(StatefulProcessor):
    """Per-field merge of the uploads of one id; the same rules as merge_reports()."""

    def __init__(self, schema: StructType, fields: list[str], keep_ms: int | None) -> None:
        self.schema, self.fields, self.keep_ms = schema, fields, keep_ms
        self.names = schema.fieldNames()[1:]
        self.whole = {f.name: isinstance(f.dataType, IntegralType) for f in schema}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", StructType(self.schema.fields[1:]))

    def _uploads(self, frames: Iterator[pd.DataFrame]) -> list[dict]:
        """The first upload and the first one of each counter that changes something, in order of arrival; retries are held once."""
        first, edits = None, {}
        for frame in frames:
            for up in frame.to_dict("records"):
                given = [] if up["changed"] is None else list(up["changed"])
                up = {k: v if k == "changed" else _plain(v, self.whole.get(k, k in ("arrival_seq", "arrival_ms"))) for k, v in up.items()}
                up["sets"] = [f for f in self.fields if up[f] is not None and (not given or f in given)]
                if first is None or up["arrival_seq"] < first["arrival_seq"]:
                    first = up
                if up["sets"] and (up["counter"] not in edits or up["arrival_seq"] < edits[up["counter"]]["arrival_seq"]):
                    edits[up["counter"]] = up
        seen = {u["arrival_seq"]: u for u in [first, *edits.values()]}
        return [seen[k] for k in sorted(seen)]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        row = dict(zip(self.names, self.row.get())) if self.row.exists() else None
        moved = False
        for up in self._uploads(rows):
            if row is None:
                row = {"device_id": up["device_id"], "phone_time": up["phone_time"], **{f: up[f] for f in self.fields}, "reported_at": up["phone_time"]}
            elif up["sets"] and up["counter"] > row["counter"]:
                row.update({f: up[f] for f in up["sets"]})
            else:
                continue
            row.update(counter=up["counter"], synced_at=up["arrival_ms"], updated_at=up["arrival_ms"])
            moved = True
        if moved:
            self.row.update(tuple(row[n] for n in self.names))
            if self.keep_ms is not None:
                for old in list(self.handle.listTimers()):
                    self.handle.deleteTimer(old)
                self.handle.registerTimer(row["updated_at"] + self.keep_ms)
            yield pd.DataFrame([[key[0], *(row[n] for n in self.names)]], columns=self.schema.fieldNames(), dtype=object)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.row.clear()
        return iter(())

    def close(self) -> None:
        pass


def merged_stream(log: DataFrame, fields: list[str], keep_ms: int | None = None, delay: str = "1 hour") -> DataFrame:
    """Merged rows of a streaming edit log, each time they move.

    keep_ms: an id's state is dropped so long after its last accepted upload, by a timer on the watermark of server arrivals
    (`delay` behind the newest); uploads that arrived before the watermark are dropped too, so a late retry can't make
    a dropped report anew.  Without it nothing is ever dropped.
    """
    schema = merged_schema(log, fields)
    log = log.select("id", "device_id", "counter", "arrival_seq", "arrival_ms", "phone_time", *fields, "changed")
    if keep_ms is not None:
        log = log.withColumn("arrived", F.timestamp_millis("arrival_ms")).withWatermark("arrived", delay)
    return log.groupBy("id").transformWithStateInPandas(Merge(schema, fields, keep_ms), schema, "Append", "None" if keep_ms is None else "EventTime")


def start_merge(log: DataFrame, path: str, checkpoint: str, fields: list[str], keep_ms: int | None = None, delay: str = "1 hour", **trigger) -> StreamingQuery:
    """Streams an edit log (a streaming DataFrame) into the feed of merged rows at path."""
    spark = log.sparkSession
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)  # read when the stream starts; keyed state with timers needs it
    try:
        writer = merged_stream(log, fields, keep_ms, delay).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()
    finally:
        spark.conf.set(PROVIDER, before)


def newest(feed: DataFrame) -> DataFrame:
    """The newest row of each id in a feed."""
    last = feed.groupBy("id").agg(F.max(F.struct("updated_at", "counter")).alias("m")).select("id", "m.*")
    return feed.join(last, ["id", "updated_at", "counter"], "left_semi")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The merged reports of a feed."""
    return newest(spark.read.parquet(path))


def start_feed(spark: SparkSession, path: str, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Passes the feed at path on to out as a stream of its own: rows once each, over restarts too."""
    feed = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    writer = feed.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def refresh_severity(reports: DataFrame, since: int, t: Tuning) -> DataFrame:
    """Rows that moved at or after a cursor, with their urgency as of now."""
    return reports.where(F.col("updated_at") >= since).withColumn("severity", severity(t))


def map_batch(spark: SparkSession, path: str, number: int, changes: DataFrame, t: Tuning) -> None:
    """One tick of the live map: takes up changed reports (whole rows, an id once) and writes reports, clusters and zones as version=number.

    It reads version number - 1 only, so a tick that is run again writes the same.
    """
    reports, state = changes, None
    if number:
        before = spark.read.parquet(f"{path}/reports/version={number - 1}")
        reports = before.join(changes.select("id"), "id", "left_anti").unionByName(changes)
        state = spark.read.parquet(f"{path}/clusters/version={number - 1}")
    reports.write.mode("overwrite").parquet(f"{path}/reports/version={number}")
    live.advance(state, changes, None, t.radius_m).write.mode("overwrite").parquet(f"{path}/clusters/version={number}")
    refresh_map(spark, path, number, t)


def refresh_map(spark: SparkSession, path: str, number: int, t: Tuning) -> None:
    """Writes the zones of a version as of t.now_ms; confidence decays even when nothing arrives."""
    reports, state = (spark.read.parquet(f"{path}/{k}/version={number}") for k in ("reports", "clusters"))
    live.zones_now(reports, state, t).write.mode("overwrite").parquet(f"{path}/zones/version={number}")


def start_live_map(changes: DataFrame, path: str, checkpoint: str, clock, **trigger) -> StreamingQuery:
    """A tick of the map for every micro-batch of changed reports (streaming); clock() gives the time in ms."""
    spark = changes.sparkSession

    def tick(batch: DataFrame, number: int) -> None:
        last = batch.groupBy("id").agg(F.max("synced_at").alias("synced_at"))
        map_batch(spark, path, number, batch.join(last, ["id", "synced_at"], "left_semi").dropDuplicates(["id"]).select(batch.columns), Tuning(now_ms=clock()))

    writer = changes.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def stream_files(spark: SparkSession, path: str, schema: StructType, view: str, files_per_batch: int = 1) -> DataFrame:
    """A view over files of events that arrive in a folder, as a stream."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    rows = spark.sql(VIEWS[view].replace("FROM events", "FROM {events}"), events=events)
    if view != "edit_log":
        return rows
    changed = F.when(F.col("changed_csv") == "", F.array().cast("array<string>")).otherwise(F.split("changed_csv", ","))
    return rows.withColumn("changed", changed).drop("changed_csv")
