"""Bounded samples of labelled rows for fitting small models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: str = "doc_id") -> Column:
    """The fold kept from training: crc32 of the id as text, remainder 2 of 4; rows without an id are not in it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def by_label(rows: DataFrame, label: str, each: int, doc_id: str = "doc_id") -> DataFrame:
    """About `each` rows of every label (all of a rarer one), chosen by a hash of the id; twice as many at most but for chance.

    One count by label sets the share of hash values that is let in, so no task ever holds a whole label.
    """
    spark = rows.sparkSession
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}  # one row a label
    if not counts:
        return rows.limit(0)
    share = spark.createDataFrame([(k, min(1.0, each / n)) for k, n in counts.items()], f"__of {rows.schema[label].dataType.simpleString()}, __share double")
    value = F.pmod(F.xxhash64(F.col(doc_id), F.lit(7)), F.lit(1_000_003)) / 1_000_003.0
    return rows.join(F.broadcast(share), F.col(label) == F.col("__of")).where(value < F.col("__share")).drop("__of", "__share")
