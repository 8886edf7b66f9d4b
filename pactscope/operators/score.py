"""Aggregates over assessed clauses (A1-A5, A10).

All of them are plain grouped aggregates with map-side partial results, so a
contract or category holding a large share of the clauses costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.functions.lexicon import FAIRNESS_WEIGHT_TENTHS as W
from pactscope.functions.lexicon import RISK_ORDINAL


def risk_ordinal(level: Column) -> Column:
    expr = F.lit(0)
    for name, rank in RISK_ORDINAL.items():
        expr = F.when(level == name, rank).otherwise(expr)
    return expr


def level_of(ordinal: Column) -> Column:
    expr = F.lit(None).cast("string")
    for name, rank in RISK_ORDINAL.items():
        expr = F.when(ordinal == rank, name).otherwise(expr)
    return expr


def _bearing() -> Column:
    return F.coalesce(F.col("is_risk_bearing"), F.lit(True))


def fairness_sums() -> list[Column]:
    """Aggregates a score needs; all are exact integer sums and counts."""
    level = F.upper(F.coalesce("risk_level", F.lit("LOW")))
    weight = (
        F.when(~_bearing(), W["NON_RISK"])
        .when(level == "HIGH", W["HIGH"])
        .when(level == "MEDIUM", W["MEDIUM"])
        .when(level == "NEUTRAL", W["NEUTRAL"])
        .otherwise(W["LOW"])
    )
    fair = F.greatest(F.lit(0), F.least(F.lit(100), 100 - F.coalesce("unfairness", F.lit(25))))
    return [
        F.sum((fair * weight).cast("bigint")).alias("_fair"),
        F.sum(weight.cast("bigint")).alias("_weight"),
        F.count_if(_bearing() & (level == "HIGH")).alias("high_count"),
        F.count_if(_bearing() & (level == "MEDIUM")).alias("medium_count"),
        F.count(F.lit(1)).alias("n_clauses"),
    ]


def fairness_from_sums() -> Column:
    """Score 10-100 from ``fairness_sums``; 50 where there are no clauses."""
    high = F.col("high_count")
    penalty = F.when(high >= 3, 16 + (high - 2) * 5).otherwise(high * 8)
    score = F.bround(F.col("_fair") / F.nullif(F.col("_weight"), F.lit(0)) - penalty).cast("bigint")
    return F.coalesce(F.when(score.isNotNull(), F.greatest(F.lit(10), F.least(F.lit(100), score))), F.lit(50)).cast("bigint")


def overall_fairness(assessed: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """A1: fairness 10-100 per contract; ``documents`` adds contracts without clauses (score 50)."""
    sums = assessed.groupBy("doc_id").agg(*fairness_sums())
    if documents is not None:
        sums = documents.select("doc_id").join(sums.hint("merge"), "doc_id", "left").fillna(
            0, subset=["high_count", "medium_count", "n_clauses"]
        )
    return sums.select("doc_id", fairness_from_sums().alias("fairness"), "high_count", "medium_count", "n_clauses")


def risk_counts(assessed: DataFrame) -> DataFrame:
    """A2: HIGH and MEDIUM clauses per contract, with and without regard to the risk-bearing flag."""
    bearing = F.coalesce(F.col("is_risk_bearing"), F.lit(True))
    high, medium = F.col("risk_level") == "HIGH", F.col("risk_level") == "MEDIUM"
    return assessed.groupBy("doc_id").agg(
        F.count_if(high & bearing).alias("high_count"),
        F.count_if(medium & bearing).alias("medium_count"),
        F.count_if(high).alias("high_any"),
        F.count_if(medium).alias("medium_any"),
    )


def risk_distribution(assessed: DataFrame) -> DataFrame:
    """A3: clauses per level and in total."""
    return assessed.groupBy("doc_id").agg(
        *[F.count_if(F.col("risk_level") == name).alias(f"{name.lower()}_count") for name in RISK_ORDINAL],
        F.count(F.lit(1)).alias("total_clauses"),
    )


def category_summary(assessed: DataFrame) -> DataFrame:
    """A4: clauses and highest level per contract and category."""
    return (
        assessed.groupBy("doc_id", "category")
        .agg(F.count(F.lit(1)).alias("clause_count"), F.max(risk_ordinal(F.col("risk_level"))).alias("_top"))
        .select("doc_id", "category", "clause_count", level_of(F.col("_top")).alias("highest_risk"))
    )


def risk_pages(assessed: DataFrame) -> DataFrame:
    """A5: pages that hold a risk-bearing HIGH clause."""
    bearing = F.coalesce(F.col("is_risk_bearing"), F.lit(True))
    return (
        assessed.where((F.col("risk_level") == "HIGH") & bearing)
        .select("doc_id", F.coalesce("page_no", F.lit(1)).cast("bigint").alias("page_no"))
        .distinct()
    )


def portfolio_rollup(assessed: DataFrame) -> DataFrame:
    """A10: clauses, contracts and mean score by category and level, with subtotals.

    A contract gives one row per category and level, one per category and one in all, so counting rows counts contracts.
    Subtotals are told from missing categories by their grouping, not by null.
    """
    cells = assessed.groupBy("doc_id", "category", "risk_level").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("unfairness").cast("bigint")).alias("u")
    )
    sets = [[F.col(c) for c in names] for names in (["doc_id", "category", "risk_level"], ["doc_id", "category"], ["doc_id"])]
    levels = cells.groupingSets(sets, "doc_id", "category", "risk_level").agg(
        F.sum("n").alias("n"), F.sum("u").alias("u"), F.grouping_id().alias("_of")
    )
    totals = levels.groupBy("category", "risk_level", "_of").agg(
        F.sum("n").alias("clause_count"), F.sum("u").alias("_sum"), F.count(F.lit(1)).alias("contract_count")
    )
    return totals.select(
        F.when(F.col("_of") == 3, F.lit("ALL")).otherwise(F.col("category")).alias("category"),
        F.when(F.col("_of") > 0, F.lit("ALL")).otherwise(F.col("risk_level")).alias("risk_level"),
        "clause_count",
        "contract_count",
        F.round(F.col("_sum") / F.col("clause_count"), 6).alias("mean_unfairness"),
    )


def least_fair(scores: DataFrame, k: int = 20) -> DataFrame:
    """The k contracts with the lowest fairness (a top-k report)."""
    return scores.orderBy(F.col("fairness"), F.col("high_count").desc(), F.col("doc_id")).limit(k)
