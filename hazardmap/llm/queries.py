"""The registered queries of this folder: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import decontaminate, html, jaccard, langid, licenses, line_runs, negatives, orchard, packing, pii, quality, sql, toxicity
from .samples import held_out
from .store import table
from .token_counts import token_counts


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_spans")


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    samples = langid.learn(docs.where(~held_out()))
    found = langid.identify(docs.select("doc_id", "text"), samples)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), with_text=False)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out()))
    found = toxicity.score_toxicity(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.transform("items", lambda x: x["item_id"]).alias("item_ids"), "coverage", "contaminated")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_runs.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = orchard.cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256).alias("centroid_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_licenses": op1_licenses,
    "op2_pii": op2_pii,
    "op3_language": op3_language,
    "op4_quality": op4_quality,
    "op5_jaccard": op5_jaccard,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_token_counts": op8_token_counts,
    "op9_html": op9_html,
    "op10_decontaminate": op10_decontaminate,
    "op11_line_dedup": op11_line_dedup,
    "op12_clusters": op12_clusters,
    "op13_hard_negatives": op13_hard_negatives,
}
#: The others rest on trained models, tokenizers, tiling or packing, which SQL does not have.
ORACLES: dict[str, str] = {"op4_quality": sql.QUALITY, "op5_jaccard": sql.JACCARD, "op11_line_dedup": sql.LINES, "op12_clusters": sql.CLUSTERS, "op13_hard_negatives": sql.NEGATIVES}
