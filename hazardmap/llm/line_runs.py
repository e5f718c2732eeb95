"""Line dedup over levelled sorted runs of line hashes; DataFrame functions only.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased.  Keys of enough code points
that enough documents hold lose all their lines except in the largest doc_id that holds them.

Documents come in batches, those of the largest ids first.  The keys of a batch are merge-anti-joined with the runs of
all batches before it: what is left was never seen, so the batch holds its largest document, and these keys become a
run of their own, sorted by hash.  As soon as a level has `fan` runs they are compacted into one run of the next
level, so that a batch meets a number of runs that grows with the logarithm of the number of batches.

Defined cases: a null or empty text is one empty line; repeated rows count as one document and keep or lose the same
lines; rows of one doc_id with different texts are one document; rows without a doc_id are documents by their text
and come after all others, and a key that only such rows hold stays in all of them; an empty table gives an empty
result.  Hashes are 128 bits wide (MD5).
"""

from __future__ import annotations

import uuid
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import keep, shared_dir

BLANKS = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(stripped: Column) -> Column:
    """A line without white space at its ends, with A-Z lower-cased and nothing else."""
    ascii_only = F.octet_length(stripped) == F.char_length(stripped)
    return F.when(ascii_only, F.lower(stripped)).otherwise(F.translate(stripped, ascii_uppercase, ascii_lowercase))


def hashed_lines(docs: DataFrame, least_chars: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, body, pos, key) of every line whose key has at least least_chars code points; body tells texts of one id apart."""
    rows = docs.select(F.col(doc_id).alias("doc"), F.xxhash64(text).alias("body"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(BLANKS))).where(F.char_length("line") >= least_chars)
    return rows.select("doc", "body", "pos", F.unhex(F.md5(line_key(F.col("line")))).alias("key"))


def repeated_keys(lines: DataFrame, least_docs: int) -> DataFrame:
    """Keys in at least least_docs documents.  (key, document) pairs are made distinct first, so a very common line is many small rows."""
    held = lines.select("key", "doc", F.when(F.col("doc").isNull(), F.col("body")).alias("body")).distinct()
    return held.groupBy("key").agg(F.count("*").alias("docs")).where(F.col("docs") >= least_docs).select("key")


class Runs:
    """Sorted runs of (key, keeper) by level, in the shared folder; no key stands in two of them."""

    def __init__(self, spark: SparkSession, fan: int = 4) -> None:
        self.spark, self.fan = spark, fan
        self.levels: list[list[DataFrame]] = [[]]

    def all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    def unseen(self, own: DataFrame) -> DataFrame:
        """Rows of own (with a column key) whose key no run holds."""
        seen = self.all()
        return own if seen is None else own.join(seen.hint("merge"), "key", "left_anti")

    def add(self, own: DataFrame) -> None:
        """Adds the keys of a batch (key, keeper; keys once) that are unseen as a run, and compacts full levels."""
        self.levels[0].append(keep(self.unseen(own).sortWithinPartitions("key"), "run"))
        for n, level in enumerate(self.levels):
            if len(level) < self.fan:
                break
            merged = reduce(DataFrame.unionByName, level).repartition("key").sortWithinPartitions("key")
            if n + 1 == len(self.levels):
                self.levels.append([])
            self.levels[n + 1].append(keep(merged, "run"))
            level.clear()


def in_batches(held: DataFrame, docs: DataFrame, batches: int, doc_id: str) -> DataFrame:
    """held with its batch, 0 for the largest ids; rows without an id are in the last one.  Cuts are about even shares of the ids."""
    cuts = docs.agg(F.percentile_approx(doc_id, [i / batches for i in range(1, batches)], 1000)).first()[0] if batches > 1 else None
    number = reduce(lambda a, b: a + b, (F.when(F.col("doc") < c, 1).otherwise(0) for c in sorted(set(cuts or []))), F.lit(0))
    return held.withColumn("batch", F.when(F.col("doc").isNull(), batches - 1).otherwise(number))


def dedup_lines(docs: DataFrame, least_chars: int = 40, least_docs: int = 5, batches: int = 8, fan: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped (long) and kept_text; columns of these names are replaced.  doc_id is a number."""
    spark = docs.sparkSession
    lines = keep(hashed_lines(docs, least_chars, doc_id, text), "lines")
    repeated = keep(repeated_keys(lines, least_docs), "repeated")  # two plain shuffles meet in the join, so a very common key can be split
    held = in_batches(lines.join(repeated, "key", "left_semi"), docs, batches, doc_id)
    path = f"{shared_dir(spark)}/held-{uuid.uuid4().hex}"
    held.write.partitionBy("batch").parquet(path)
    held = spark.read.schema(held.schema).parquet(path)
    runs = Runs(spark, fan)
    for n in range(batches):
        runs.add(held.where(F.col("batch") == n).groupBy("key").agg(F.max("doc").alias("keeper")))
    lost = held.join(runs.all(), "key").where(~F.col("doc").eqNullSafe(F.col("keeper")))
    lost = lost.groupBy("doc", "body").agg(F.collect_set("pos").alias("__lost")).withColumnsRenamed({"doc": "__doc", "body": "__of"})
    met = docs.withColumn("__body", F.xxhash64(text)).join(lost, F.col(doc_id).eqNullSafe(F.col("__doc")) & (F.col("__body") == F.col("__of")), "left")
    rows = lines_of(F.col(text))
    here = F.transform(F.array(rows), lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__lost")), lambda p: ls[p]), "\n"))[0]
    out = met.withColumns(
        {
            "n_lines": F.size(rows).cast("long"),
            "n_dropped": F.coalesce(F.size("__lost"), F.lit(0)).cast("long"),
            "kept_text": F.when(F.col("__lost").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(here),
        }
    )
    return out.drop("__body", "__doc", "__of", "__lost")
