"""From deduplicated evidence to a score and decision for every chunk and category."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlens.config import METHODS, Category, Config
from hushlens.functions import text as T

# Fixed value: what the explanation says without evidence.
NO_EVIDENCE = "Aucune evidence significative."


def per_category(config: Config, value: Callable[[Category], object], kind: str) -> Column:
    """A value of the row's category, as a literal."""
    out = F.lit(None).cast(kind)
    for c in config.categories:
        out = F.when(F.col("cat_ord") == c.cat_ord, F.lit(value(c)).cast(kind)).otherwise(out)
    return out


def method_scores(evidence: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The best score of each method: keys, cat_ord, method, method_score."""
    return evidence.groupBy(*keys, "cat_ord", "method").agg(F.max("score").alias("method_score"))


def method_rank() -> Column:
    """Position of the method; unknown ones stand beyond the last."""
    out = F.lit(99)
    for n, m in enumerate(METHODS):
        out = F.when(F.col("method") == m, n).otherwise(out)
    return out


def category_scores(evidence: DataFrame, config: Config, keys: Sequence[str]) -> DataFrame:
    """Rows with evidence: keys, cat_ord, score, n_evidence, explanation and one best score a method.

    The weighted mean goes over the methods that found something, in fixed order, so sums do not depend on row order.
    """
    order = F.struct((-F.col("score")).alias("s"), (-method_rank()).alias("m"), "sentence_index", "method_seq", "term_ord", "method", "trigger", "score")
    best = {m: F.max(F.when(F.col("method") == m, F.col("score"))).alias(f"best_{m}") for m in METHODS}
    grouped = evidence.groupBy(*keys, "cat_ord").agg(*best.values(), F.count(F.lit(1)).alias("n_evidence"), F.slice(F.sort_array(F.collect_list(order)), 1, 3).alias("_top"))
    total, weights = F.lit(0.0), F.lit(0.0)
    for m in METHODS:
        weight = per_category(config, lambda c, m=m: config.weight(c, m), "double")
        there = F.col(f"best_{m}").isNotNull()
        total = total + F.when(there, F.col(f"best_{m}") * weight).otherwise(0.0)
        weights = weights + F.when(there, weight).otherwise(0.0)
    mean = F.when(weights != 0, total / weights).otherwise(0.0)
    bonus = F.least(F.lit(0.15), (F.col("n_evidence") - 1) * F.lit(0.03))
    shown = F.array_join(F.transform("_top", lambda e: F.concat(e["method"], F.lit(" -> '"), e["trigger"], F.lit("' ("), T.two_places(e["score"]), F.lit(")"))), "; ")
    return grouped.withColumns({"score": F.round(F.least(F.lit(1.0), mean + bonus), 4), "explanation": shown}).drop("_top")


def decide(score: Column, config: Config) -> Column:
    alert = per_category(config, lambda c: config.threshold(c, "alert"), "double")
    review = per_category(config, lambda c: config.threshold(c, "review"), "double")
    return F.when(score >= alert, "alert").when(score >= review, "review").otherwise("clear")


def category_results(chunks: DataFrame, scores: DataFrame, config: Config, keys: Sequence[str]) -> DataFrame:
    """One row per chunk and category, those without evidence with score 0.0."""
    listed = F.array(*(F.struct(F.lit(c.cat_ord).alias("cat_ord"), F.lit(c.key).alias("category_key"), F.lit(c.label).alias("category_label")) for c in config.categories))
    rows = chunks.select("*", F.explode(listed).alias("_c")).select(*chunks.columns, "_c.*").join(scores, [*keys, "cat_ord"], "left")
    rows = rows.withColumns({"score": F.coalesce("score", F.lit(0.0)), "n_evidence": F.coalesce("n_evidence", F.lit(0)), "explanation": F.coalesce("explanation", F.lit(NO_EVIDENCE))})
    return rows.withColumn("decision", decide(F.col("score"), config))
