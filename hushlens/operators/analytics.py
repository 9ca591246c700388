"""Exploratory aggregates over findings and audit records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by(findings: DataFrame, column: str) -> DataFrame:
    """Findings by category, file, decision or method, most first."""
    return findings.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)


def pivot_file_category(findings: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Findings by file and category, 0 where there are none; labels are those of the configuration, so no pass is needed to find them."""
    return findings.groupBy("file_name").pivot("category_label", list(labels)).agg(F.count("matched_text")).na.fill(0)


def top(findings: DataFrame, n: int) -> DataFrame:
    return findings.orderBy(F.desc("category_score"), F.desc("raw_score"), "file_path", "chunk_id", "cat_ord", "ev_ord").limit(n)


def top_file(findings: DataFrame) -> DataFrame:
    """The file with most findings, the first by name of equals."""
    return count_by(findings, "file_name").limit(1)


def overview(audit: DataFrame) -> DataFrame:
    """Per chunk its categories that are not clear and its decision log, as text."""
    active = F.filter("categories", lambda c: c["decision"] != "clear")
    shown = F.array_join(F.transform(active, lambda c: F.concat(c["category_key"], F.lit(":"), c["decision"])), " | ")
    return audit.select("text_id", "metadata.file_path", "metadata.chunk_id", shown.alias("active_categories"), F.array_join("decision_log", " | ").alias("decision_log"))


def first_flagged(audit: DataFrame) -> DataFrame:
    """The first record with a flagged category; without one the first record."""
    flagged = F.exists("categories", lambda c: c["decision"] != "clear")
    return audit.withColumn("_f", flagged).orderBy(F.desc("_f"), "metadata.file_path", "metadata.chunk_id").limit(1).drop("_f")


def decision_log_counts(audit: DataFrame) -> DataFrame:
    return audit.select(F.explode("decision_log").alias("entry")).groupBy("entry").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "entry")
