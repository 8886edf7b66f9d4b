"""Cross-references between clauses of one contract (X1-X4) and the full assessment.

The full assessment reads every clause once. A contract is one admitted file, so
its clauses are brought together by ``doc_id`` (nothing moves where they already
are); citations meet the clause they name, and what they inherit meets the citing
clause, in two windows over that one partitioning, as numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactscope.functions.lexicon import PATTERNS
from pactscope.functions.text import all_groups, contains_any, first_group, has_words, let, strip
from pactscope.functions.wording import RELATION_TEXTS
from pactscope.operators.rules import (
    ASSESSED,
    MITIGATIONS,
    decision,
    mitigation,
    settled,
    with_lowered,
    with_outcome,
    with_rule_flags,
    with_structure,
    with_tests,
)

_CITING_WORDS = ["section", "clause", "article", "paragraph"]  # "subsection" contains "section"


def clause_label() -> Column:
    """Number or roman numeral at the start of the title, else of the text."""
    pattern = PATTERNS["clause_label"]
    return F.coalesce(
        first_group(F.col("_ttl"), pattern), first_group(F.substring(strip(F.col("_body")), 1, 60), pattern)
    )


def mentions() -> Column:
    """Distinct labels cited by the text, in order of appearance."""
    return F.when(
        contains_any("_body", _CITING_WORDS),
        F.array_distinct(all_groups(F.col("_body"), PATTERNS["reference_mention"])),
    ).otherwise(F.array().cast("array<string>"))


def _packed(flags: dict[str, Column]) -> Column:
    """Position and mitigation flags as one number, so that the first clause of a label is a plain minimum."""
    bits = sum((flags[m].cast("bigint") * 2**i for i, m in enumerate(MITIGATIONS)), F.lit(0).cast("bigint"))
    return F.col("idx").cast("bigint") * 16 + bits


def build_label_index(clauses: DataFrame) -> DataFrame:
    """First clause per (doc_id, label) with its mitigation flags."""
    labelled = with_lowered(clauses).withColumn("label", clause_label()).where(F.col("label").isNotNull())
    row = labelled.select("doc_id", "label", _packed(mitigation()).alias("packed"))
    best = row.groupBy("doc_id", "label").agg(F.min("packed").alias("packed"))
    return best.select(
        "doc_id",
        "label",
        F.floor(F.col("packed") / 16).cast("int").alias("dst_idx"),
        *[(F.col("packed").bitwiseAND(2**i) != 0).alias(m) for i, m in enumerate(MITIGATIONS)],
    )


def _wording(body: Column, label: Column) -> Column:
    """How the text around the first mention of ``label`` introduces it.

    The text around it begins 80 characters before at the earliest. It is looked for from there on, behind the character
    before: from every place the search would go through 80 characters.
    """
    quoted = F.replace(label, F.lit("."), F.lit("\\."))
    mention = F.concat(F.lit(r"\b(?:section|clause|article|subsection|paragraph)\s+"), quoted, F.lit(r"\b"))
    first = lambda text, pattern: F.call_function("regexp_extract", text, pattern, F.lit(1))
    around = F.concat(F.lit("(?dU)(?s:.)((?:.{0,80})?"), mention, F.lit("(?:.{0,80})?)"))
    rest = let(
        F.length(first(body, F.concat(F.lit("(?dUs)^(.*?)"), mention))) + 1,
        lambda at: F.when(at > 81, F.substring(body, at - 81, F.length(body))).otherwise(F.concat(F.lit("\n"), body)),
    )
    return let(
        F.coalesce(F.nullif(first(rest, around), F.lit("")), body),
        lambda window: F.when(has_words(window, "reference_overrides"), "overrides")
        .when(has_words(window, "reference_limits"), "limits")
        .when(has_words(window, "reference_expands"), "expands")
        .otherwise("unrelated"),
    )


def citing_clauses(clauses: DataFrame) -> DataFrame:
    """One row per (citing clause, cited label) with the wording of the citation."""
    cited = with_lowered(clauses).withColumn("_mentions", mentions()).where(F.size("_mentions") > 0)
    spread = cited.select(
        "doc_id", F.col("idx").alias("src_idx"), "_body", F.posexplode("_mentions").alias("mention_no", "label")
    )
    return spread.select(
        "doc_id", "src_idx", "mention_no", "label", _wording(F.col("_body"), F.col("label")).alias("wording")
    )


def resolve_references(clauses: DataFrame, exclude_self: bool = True) -> DataFrame:
    """Resolved edges (doc_id, src_idx, dst_idx, label, relation).

    Each clause carries one label, so distinct labels mean distinct targets. ``exclude_self`` drops
    a clause that cites itself; the assessment keeps it, because it resolves labels without ids.
    """
    joined = citing_clauses(clauses).join(build_label_index(clauses).hint("merge"), ["doc_id", "label"])
    protective = F.col("has_cap") | F.col("has_mutuality") | F.col("has_cure_period")
    relation = F.when((F.col("wording") == "limits") & protective, "mitigates").otherwise(F.col("wording"))
    edges = joined.withColumn("relation", relation)
    if exclude_self:
        edges = edges.where(F.col("src_idx") != F.col("dst_idx"))
    return edges.select("doc_id", "src_idx", "dst_idx", "mention_no", "label", "relation", *MITIGATIONS)


def explain_references(edges: DataFrame) -> DataFrame:
    """Edges with a line of text on what the citation does."""
    verbs = F.create_map(*[F.lit(x) for kv in RELATION_TEXTS.items() for x in kv])
    return edges.withColumn(
        "explanation",
        F.concat(F.lit("This clause "), F.element_at(verbs, F.col("relation")), F.lit(" Section "), F.col("label")),
    )


def _with_inherited(lowered: DataFrame, flags: dict[str, Column], carried: list[str]) -> DataFrame:
    """``carried`` columns of each clause and ``inherited``: the flags of the clauses that limit or mitigate it as one
    number, null where there are none.

    A clause is one row, each of its limiting citations another one. Rows of one contract with the same label are peers in
    the first window: a citation learns the first clause of that label. Rows of one clause are peers in the second.
    """
    cited = F.filter(mentions(), lambda label: _wording(F.col("_body"), label) == "limits")
    own = F.array(F.struct(clause_label().alias("label"), F.lit(True).alias("is_clause")))
    citing = F.transform(cited, lambda label: F.struct(label.alias("label"), F.lit(False).alias("is_clause")))
    rows = lowered.select(*carried, _packed(flags).alias("_flags"), F.inline(F.concat(own, citing)))
    peers = Window.partitionBy("doc_id").rangeBetween(Window.currentRow, Window.currentRow)
    target = F.min(F.when(F.col("is_clause"), F.col("_flags"))).over(peers.orderBy("label"))
    found = rows.withColumn("_target", F.when(~F.col("is_clause"), target.bitwiseAND(2 ** len(MITIGATIONS) - 1)))
    gained = found.withColumn("inherited", F.bit_or("_target").over(peers.orderBy("idx")))
    return gained.where("is_clause").select(*carried, "inherited")


def _inherited_flag(name: str) -> Column:
    return F.coalesce(F.col("inherited").bitwiseAND(2 ** MITIGATIONS.index(name)) != 0, F.lit(False))


def propagate_mitigation(clauses: DataFrame) -> DataFrame:
    """Mitigation a clause inherits from the clauses that limit or mitigate it."""
    found = _with_inherited(with_lowered(clauses), mitigation(), ["doc_id", "idx"]).where(F.col("inherited").isNotNull())
    return found.select("doc_id", "idx", *[_inherited_flag(m).alias("in_" + m) for m in MITIGATIONS])


def evaluate_documents(clauses: DataFrame) -> DataFrame:
    """Every clause judged with what its cited clauses contribute."""
    structured = with_tests(with_rule_flags(with_structure(clauses)), {"_code": decision()})
    own = {m: F.col("_own_" + m) for m in MITIGATIONS}
    outcome = ("category", "risk_level", "unfairness", "summary", "pushback", "risk_reasons")
    keep = [c for c in ASSESSED if c not in outcome]
    judged = _with_inherited(structured, own, [*keep, "_code"])
    rule = settled(F.col("_code"), {m: _inherited_flag(m) for m in MITIGATIONS})
    return with_outcome(judged.select(*keep, rule.alias("rule"))).select(*ASSESSED, "rule")
