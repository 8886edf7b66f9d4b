"""Clauses and documents that clients send as JSON (S7-S9); keys in either style, defaults for gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.functions.lexicon import DEFAULT_SCORE_BY_LEVEL, NON_RISK_KINDS
from pactscope.functions.text import first_present, spread
from pactscope.operators.labels import normalize_category, normalize_risk_level

_KEYS = [
    "id", "title", "text", "originalText", "riskLevel", "risk_level", "plainSummary", "plain_english_summary",
    "suggestion", "suggested_pushback", "category", "clauseKind", "clause_kind", "isRiskBearing", "is_risk_bearing",
    "unfairnessScore", "unfairness_score", "riskReasons", "risk_reasons", "pageNumber", "page_number",
    "startOffset", "start_offset", "endOffset", "end_offset",
]
_ITEMS = "array<struct<" + ", ".join(f"`{k}`: string" for k in _KEYS) + ">>"


def client_items(df: DataFrame, json: Column) -> DataFrame:
    """One row per clause of a JSON array, ``c`` holding the raw values and ``at`` the position from 1."""
    return spread(df, ["doc_id"], F.from_json(json, _ITEMS), "_p", "c").withColumn("at", F.col("_p") + 1)


def _number(*names: str) -> Column:
    return F.coalesce(*[F.expr(f"try_cast(c.{n} AS int)") for n in names])


def _bool(*names: str) -> Column:
    return F.coalesce(*[F.col("c." + n) for n in names]) != "false"


def _reasons(*names: str) -> Column:
    raw = F.coalesce(*[F.col("c." + n) for n in names])
    return F.when(raw.isNull(), F.array().cast("array<string>")).when(
        F.startswith(raw, F.lit("[")), F.from_json(raw, "array<string>")
    ).otherwise(F.array(raw))


def hydrate_clauses(df: DataFrame, json: Column) -> DataFrame:
    """Typed clauses; the flag is inferred from the kind and the score from the level where they are missing."""
    items = client_items(df, json)
    level = first_present(F.col("c.riskLevel"), F.col("c.risk_level"), F.lit("LOW"))
    kind = first_present(F.col("c.clauseKind"), F.col("c.clause_kind"), F.lit("OPERATIVE"))
    defaults = F.create_map(*[F.lit(x) for kv in DEFAULT_SCORE_BY_LEVEL.items() for x in kv])
    return items.select(
        "doc_id",
        F.col("at").alias("idx"),
        first_present(F.col("c.id"), F.concat(F.lit("clause_"), "at")).alias("clause_id"),
        first_present(F.col("c.title"), F.concat(F.lit("Clause "), "at")).alias("title"),
        first_present(F.col("c.text"), F.col("c.originalText"), F.lit(None)).alias("_text"),
        level.alias("risk_level"),
        F.coalesce(first_present(F.col("c.plainSummary"), F.col("c.plain_english_summary")), F.lit("")).alias("summary"),
        first_present(F.col("c.suggestion"), F.col("c.suggested_pushback")).alias("pushback"),
        first_present(F.col("c.category"), F.lit("OTHER")).alias("category"),
        kind.alias("clause_kind"),
        F.coalesce(_bool("isRiskBearing", "is_risk_bearing"), ~F.upper(kind).isin(NON_RISK_KINDS)).alias("is_risk_bearing"),
        F.coalesce(_number("unfairnessScore", "unfairness_score"), F.element_at(defaults, F.upper(level)), F.lit(30)).alias("unfairness"),
        _reasons("riskReasons", "risk_reasons").alias("risk_reasons"),
        F.coalesce(F.nullif(_number("pageNumber", "page_number"), F.lit(0)), F.lit(1)).alias("page_no"),
    ).withColumn("text", F.coalesce("_text", F.lit(""))).drop("_text")


def normalize_backend_clause(df: DataFrame, json: Column) -> DataFrame:
    """Display clauses; texts fall back when empty, flags and numbers only when absent."""
    items = client_items(df, json)
    return items.select(
        "doc_id",
        F.col("at").alias("idx"),
        first_present(F.col("c.id"), F.concat(F.lit("clause_"), "at")).alias("clause_id"),
        first_present(F.col("c.title"), F.concat(F.lit("Clause "), "at")).alias("title"),
        F.coalesce(first_present(F.col("c.text"), F.col("c.originalText")), F.lit("")).alias("text"),
        first_present(F.col("c.plain_english_summary"), F.col("c.plainSummary"), F.lit("Clause analyzed.")).alias("summary"),
        normalize_risk_level(first_present(F.col("c.risk_level"), F.col("c.riskLevel"))).alias("risk_level"),
        normalize_category(F.col("c.category")).alias("category"),
        F.coalesce(_number("unfairness_score", "unfairnessScore"), F.lit(40)).alias("unfairness"),
        F.coalesce("c.clause_kind", "c.clauseKind", F.lit("OPERATIVE")).alias("clause_kind"),
        F.coalesce(_bool("is_risk_bearing", "isRiskBearing"), F.lit(True)).alias("is_risk_bearing"),
        _reasons("risk_reasons", "riskReasons").alias("risk_reasons"),
        F.coalesce(_number("page_number", "pageNumber"), F.lit(1)).alias("page_no"),
    )


def normalize_backend_document(documents: DataFrame) -> DataFrame:
    """Document fields from JSON with fallbacks; the page total falls back to the number of pages, else 1."""
    head = (
        "session_id string, sessionId string, filename string, document_title string, documentTitle string, "
        "overall_fairness_score int, overallFairnessScore int, totalPages int, total_pages int, "
        "pages array<struct<pageNumber: int, page_number: int, text: string>>"
    )
    d = documents.select("doc_id", F.from_json("json", head).alias("d"))
    pages = F.coalesce(F.size("d.pages"), F.lit(0))
    return d.select(
        "doc_id",
        first_present(F.col("d.session_id"), F.col("d.sessionId"), F.concat(F.lit("doc_"), "doc_id")).alias("session_id"),
        first_present(F.col("d.filename"), F.lit("contract.pdf")).alias("filename"),
        F.coalesce("d.document_title", "d.documentTitle").alias("document_title"),
        F.coalesce("d.overall_fairness_score", "d.overallFairnessScore", F.lit(50)).alias("fairness"),
        F.coalesce(
            F.nullif("d.totalPages", F.lit(0)), F.nullif("d.total_pages", F.lit(0)), F.greatest(pages, F.lit(1))
        ).alias("total_pages"),
    )
