"""Results kept between steps in a folder that all executors share."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Where it is unset, a session on one machine (local tests and benches) gets a folder of its own; any other raises.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


TIDY_S = 30.0
_tidied = time.monotonic()


def _tidy(spark: SparkSession) -> None:
    """Has the driver collect its garbage, every TIDY_S seconds at most.

    A job of many steps leaves plans and reports of tasks; Spark drops shuffle files of steps that are over only when
    these are collected, and an idle driver lets its heap fill first.
    """
    global _tidied
    if time.monotonic() - _tidied >= TIDY_S:
        gc.collect()  # Python's handles hold plans
        spark.sparkContext._jvm.System.gc()
        _tidied = time.monotonic()


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: the lineage is cut, and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


class Rounds:
    """Rows that the rounds of a loop add to one folder: all of them are one scan, however many rounds there were."""

    def __init__(self, spark: SparkSession, name: str, schema: str) -> None:
        self.spark, self.schema, self.count = spark, schema, 0
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def add(self, df: DataFrame) -> DataFrame:
        """Writes a round and reads it again."""
        path = f"{self.path}/round={self.count}"
        df.write.parquet(path)
        _tidy(self.spark)
        self.count += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def rows(self) -> DataFrame:
        """The rows of all rounds so far."""
        return self.spark.read.schema(f"{self.schema}, round int").parquet(self.path)
