"""Findings, per-file summary and audit records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlens.functions import text as T

from .score import method_rank

# The columns of the reports, in their order.
FINDINGS = "file_name file_path file_type chunk_id page_number line_number entity_name category_label method matched_text matched_variant raw_score adjusted_score category_score decision context_hits field_hits excerpt explanation".split()
SUMMARY = "file_name file_path file_type status chunk_count finding_count max_score max_risk_level top_categories error_message".split()
METADATA = ("file_name", "file_path", "file_type", "chunk_id", "page_number")


def evidence_order() -> list[Column]:
    """Best first; of equal scores the later method; then as emitted."""
    return [F.desc("score"), method_rank().desc(), F.asc("sentence_index"), F.asc("method_seq"), F.asc("term_ord")]


def findings(evidence: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Evidence of categories that are not clear, flat, with the columns that order it (keys, cat_ord, ev_ord)."""
    flagged = results.where("decision <> 'clear'").select(*keys, "cat_ord", "category_key", "category_label", F.col("score").alias("category_score"), "decision", *(c for c in METADATA if c not in keys))
    rows = evidence.join(flagged, [*keys, "cat_ord"])
    rows = rows.withColumn("ev_ord", F.row_number().over(Window.partitionBy(*keys, "cat_ord").orderBy(*evidence_order())))
    return rows.select(
        *keys, "cat_ord", "ev_ord",
        *(c for c in ("file_name", "file_path", "file_type", "chunk_id", "page_number") if c not in keys),
        F.lit(None).cast("int").alias("line_number"), F.col("category_key").alias("entity_name"), "category_label", "method",
        F.col("trigger").alias("matched_text"), "matched_variant", F.col("score").alias("raw_score"), F.col("score").alias("adjusted_score"), "category_score", "decision",
        F.array_join("context_hits", "|").alias("context_hits"), F.array_join("field_hits", "|").alias("field_hits"), F.col("sentence").alias("excerpt"), "explanation",
    )


def summary(results: DataFrame, first_category: int) -> DataFrame:
    """One row per file, in one aggregation: each chunk has exactly one row of the first category, which counts the chunks.

    The set of shown scores has at most 101 members a category, however many chunks a file has.
    """
    flagged = F.col("decision") != "clear"
    shown = F.when(flagged, F.concat("category_key", F.lit(":"), T.two_places(F.col("score"))))
    risk = F.when(F.col("decision") == "alert", 2).when(F.col("decision") == "review", 1).otherwise(0)
    per_file = results.groupBy("file_path").agg(
        F.min("file_name").alias("file_name"), F.min("file_type").alias("file_type"), F.count_if(F.col("cat_ord") == first_category).alias("chunk_count"),
        F.sum(F.when(flagged, F.col("n_evidence")).otherwise(0)).alias("finding_count"), F.round(F.coalesce(F.max(F.when(flagged, F.col("score"))), F.lit(0.0)), 4).alias("max_score"),
        F.element_at(F.array(*map(F.lit, ("clear", "review", "alert"))), F.max(risk) + 1).alias("max_risk_level"), F.array_join(F.array_sort(F.collect_set(shown)), "|").alias("top_categories"),
    )
    return per_file.withColumns({"status": F.lit("ok"), "error_message": F.lit("")}).select(*SUMMARY)


def audit(evidence: DataFrame, results: DataFrame, keys: Sequence[str], decision_log: Sequence[str]) -> DataFrame:
    """One nested record per chunk, clear categories included: text_id, metadata, decision_log, categories."""
    item = F.struct("method", "score", "trigger", "matched_variant", "sentence", "context_hits", "field_hits", "explanation", F.struct("sentence_index", "overlap", "similarity").alias("metadata"))
    ranked = F.struct((-F.col("score")).alias("a"), (-method_rank()).alias("b"), "sentence_index", "method_seq", "term_ord", item.alias("item"))
    listed = evidence.groupBy(*keys, "cat_ord").agg(F.transform(F.sort_array(F.collect_list(ranked)), lambda e: e["item"]).alias("evidences"))
    rows = results.join(listed, [*keys, "cat_ord"], "left")
    scores = F.map_filter(F.map_from_arrays(F.array(*(F.lit(c[5:]) for c in results.columns if c.startswith("best_"))), F.array(*(F.round(c, 4) for c in results.columns if c.startswith("best_")))), lambda _, v: v.isNotNull())
    category = F.struct("cat_ord", "category_key", "category_label", "score", "decision", scores.alias("method_scores"), "explanation", F.coalesce("evidences", F.array().cast(listed.schema["evidences"].dataType)).alias("evidences"))
    per_chunk = rows.groupBy(*dict.fromkeys((*keys, *METADATA))).agg(F.array_sort(F.collect_list(category), lambda a, b: a["cat_ord"] - b["cat_ord"]).alias("categories"))
    log = F.array(*map(F.lit, decision_log)) if decision_log else F.array().cast("array<string>")
    return per_chunk.select(*(k for k in keys if k not in METADATA), F.concat_ws(":", "file_name", "chunk_id").alias("text_id"), F.struct(*METADATA).alias("metadata"), log.alias("decision_log"), "categories")
