"""Ranked and first-of selections per contract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactscope.functions.text import blank_to_null
from pactscope.operators.labels import counter_proposal
from pactscope.operators.predicates import is_materially_risky, is_risk_bearing_for_display
from pactscope.operators.score import risk_ordinal


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per group. The rank filter lets Spark prune to k rows per task before it shuffles."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def severity_order() -> list[Column]:
    return [
        risk_ordinal(F.upper("risk_level")).desc(),
        F.coalesce("unfairness", F.lit(0)).desc(),
    ]


def reason_count() -> Column:
    return F.greatest(F.size(F.coalesce("risk_reasons", F.array().cast("array<string>"))), F.lit(0))


def rank_risk_clauses(assessed: DataFrame, limit: int = 7, counted: str | None = None) -> DataFrame:
    """Materially risky clauses by level, score and number of reasons; ties keep document order.

    ``counted`` names a column for how many of them the contract has, before the cut.
    """
    risky = assessed.where(is_materially_risky())
    if counted:
        risky = risky.withColumn(counted, F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    return top_per_group(risky, ["doc_id"], [*severity_order(), reason_count().desc(), F.col("idx")], limit)


def first_focus_clause(assessed: DataFrame) -> DataFrame:
    """First HIGH, else MEDIUM, else any risk-bearing clause; null when there is none."""
    tier = F.when(F.col("risk_level") == "HIGH", 1).when(F.col("risk_level") == "MEDIUM", 2).otherwise(3)
    candidate = F.when(is_risk_bearing_for_display(), F.struct(tier.alias("tier"), "idx", "clause_id"))
    return (
        assessed.select("doc_id", candidate.alias("c"))
        .groupBy("doc_id")
        .agg(F.min("c").alias("c"))
        .select("doc_id", F.col("c.clause_id").alias("clause_id"), F.col("c.tier").cast("bigint").alias("tier"))
    )


def headline_risks(assessed: DataFrame) -> DataFrame:
    """What a contract's summary leads with, and the clauses it cites.

    The result lists every HIGH clause of a contract, so it is as large as one contract at most.
    """
    entry = F.struct("idx", "clause_id", "title")

    def listed(level: str) -> Column:
        named = is_risk_bearing_for_display() & (F.col("risk_level") == level)
        return F.array_sort(F.collect_list(F.when(named, entry)))

    lists = assessed.groupBy("doc_id").agg(listed("HIGH").alias("high"), listed("MEDIUM").alias("medium"))
    n_high, n_medium = F.size("high"), F.size("medium")
    tier = (
        F.when(n_high >= 2, "SEVERAL_HIGH")
        .when(n_high == 1, "ONE_HIGH")
        .when(n_medium >= 1, "MEDIUM")
        .otherwise("NONE")
    )
    chosen = F.when(n_high >= 1, F.col("high")).when(n_medium >= 1, F.slice("medium", 1, 2))
    return lists.select(
        "doc_id",
        tier.alias("tier"),
        F.coalesce(F.array_join(F.slice(F.transform(chosen, lambda c: c["title"]), 1, 2), " | "), F.lit("")).alias(
            "titles"
        ),
        F.coalesce(F.array_join(F.transform(chosen, lambda c: c["clause_id"]), ","), F.lit("")).alias("cited"),
    )


def applicable_suggestion(context: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Per context, the first HIGH clause with a pushback."""
    usable = (F.col("risk_level") == "HIGH") & blank_to_null(F.col("pushback")).isNotNull()
    best = (
        context.where(usable)
        .groupBy(*keys)
        .agg(F.min(F.struct(F.col(position), F.col("clause_id"), F.col("title"), F.col("pushback"))).alias("s"))
    )
    return best.select(
        *keys,
        F.col("s.clause_id").alias("target_clause_id"),
        F.col("s.pushback").alias("counter_clause"),
        F.concat(F.lit("Replaces one-sided terms of "), F.col("s.title"), F.lit(" with mutual, capped ones.")).alias(
            "rationale"
        ),
    )


def material_risk_report(assessed: DataFrame, documents: DataFrame, asked: int = 5, limit: int = 7) -> DataFrame:
    """Numbered material clauses per contract; one "none" row for a contract without any."""
    ranked = rank_risk_clauses(assessed, limit, counted="n_material").withColumn("_counter", counter_proposal())
    lines = ranked.select(
        "doc_id",
        F.col("rank").cast("bigint").alias("ord"),
        "title",
        "risk_level",
        "summary",
        F.concat(F.lit("[CITE:"), "clause_id", F.lit("]")).alias("citation"),
        F.when(F.col("rank") == 1, F.col("_counter")).alias("counter_proposal"),
        "n_material",
    )
    report = documents.select("doc_id").join(lines.hint("merge"), "doc_id", "left")
    n = F.coalesce("n_material", F.lit(0))
    return report.select(
        "doc_id",
        F.coalesce("ord", F.lit(0)).cast("bigint").alias("ord"),
        F.coalesce("title", F.lit("none")).alias("title"),
        F.coalesce("risk_level", F.lit("")).alias("risk_level"),
        F.coalesce("summary", F.lit("")).alias("summary"),
        F.coalesce("citation", F.lit("")).alias("citation"),
        F.coalesce("counter_proposal", F.lit("")).alias("counter_proposal"),
        n.cast("bigint").alias("n_material"),
        F.greatest(F.lit(0), asked - n).cast("bigint").alias("missing_of_asked"),
    )
