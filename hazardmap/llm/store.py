"""Reading the tables; intermediate results are kept as in the rest of the library."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import keep, shared_dir

__all__ = ["keep", "release", "shared_dir", "small_batches", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Texts are wide rows, and a Python worker holds a batch of them at a time.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds on Arrow batches to BATCH_ROWS and BATCH_BYTES; lower ones of the session's own stay.

    Spark reads them when a query runs, so they can't be set back after an operator has returned its plan.
    Results do not depend on them.
    """
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        now = spark.conf.get(key).removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives what a task has freed back to the system, so that reused workers start the next stage small."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim:
        trim(0)
