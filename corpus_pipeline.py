"""A corpus pipeline: toxic documents go, near copies go but for one of each group, documents that hold benchmark
passages go, personal data is replaced by its kind, and what stays is packed into training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
Rows with null text pass every filter (they hold nothing to reject) and are packed as empty documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardmap.llm.decontaminate import decontaminate
from hazardmap.llm.jaccard import one_of_each
from hazardmap.llm.packing import pack_documents
from hazardmap.llm.pii import find_pii
from hazardmap.llm.samples import held_out
from hazardmap.llm.store import keep, table
from hazardmap.llm.toxicity import learn, score_toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows among docs, does not call toxic."""
    model = learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score_toxicity(docs, model).where("text is null or predicted = 0").select(docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the least doc_id; of repeated rows one."""
    return one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).where(~F.col("contaminated")).select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind in angle brackets; n_chars follows the new text."""
    found = find_pii(docs, redacted=True).withColumn("text", F.col("redacted_text"))
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 ids."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard", drop_copies),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("packing", pack),
]

#: Classifiers, tiling and packing have no SQL; tests/llm holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
