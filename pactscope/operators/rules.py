"""Structural classification and risk rules (R1-R18) as Column expressions.

The rules form a decision table: the columns of a clause select one rule code,
and the rule code selects a row of the ``OUTCOMES`` dimension. Deciding is
one lazy CASE expression over a few shared flags; no Python runs per row.
What a clause inherits from clauses it cites can turn only a few codes into
others (``settled``), so texts are read once and a number per clause is enough
to finish the assessment.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.functions import lexicon as lex
from pactscope.functions.text import apart, has_more_words_than, has_pattern, has_words, matches, sql_literal, strip
from pactscope.functions.wording import OUTCOMES

MITIGATIONS = ["has_cap", "has_mutuality", "has_condition", "has_cure_period"]
ASSESSED = [
    "doc_id", "idx", "clause_id", "title", "text", "page_no", "start_offset", "end_offset", "clause_kind",
    "is_risk_bearing", "category", "risk_level", "unfairness", "summary", "pushback", "risk_reasons",
]


# -- shared text columns ----------------------------------------------------
def with_lowered(clauses: DataFrame) -> DataFrame:
    """Adds lower-cased ``_body``, ``_ttl`` and ``_full`` (title and text)."""
    return clauses.withColumns(
        {
            "_body": F.lower("text"),
            "_ttl": strip(F.lower("title")),
            "_full": strip(F.lower(F.concat("title", F.lit("\n"), "text"))),
        }
    )


def with_tests(clauses: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Adds columns of many tests of a clause's words, outside whole-stage code (see ``apart``)."""
    return clauses.withColumns({"idx": apart(F.col("idx")), **tests})


# -- R1: named pattern flags ------------------------------------------------
_TITLE_AND_TEXT = [
    "boilerplate", "operative_trap", "consequence", "covenant_verb", "governing_law", "notices", "severability",
    "counterparts", "entire_agreement",
]


def pattern_flag(name: str) -> Column:
    if name in _TITLE_AND_TEXT:
        return has_pattern("_full", name)
    if name in ("recital", "clause_label"):
        return has_pattern("_body", name) | has_pattern("_ttl", name)
    return has_pattern("_body", name)


def pattern_flags(clauses: DataFrame) -> DataFrame:
    """One 0/1 column per named pattern."""
    return with_lowered(clauses).select(
        "doc_id", apart(F.col("idx")).alias("idx"), *[pattern_flag(n).cast("bigint").alias(n) for n in lex.PATTERNS]
    )


# -- R2-R5: structure -------------------------------------------------------
def with_structure(clauses: DataFrame) -> DataFrame:
    """Adds ``clause_kind``, ``is_risk_bearing`` and the helper flags behind them."""
    body, ttl, full = F.col("_body"), F.col("_ttl"), F.col("_full")
    stripped = strip(body)

    base = with_tests(with_lowered(clauses), {"_trap": has_pattern("_body", "operative_trap")})
    substantive = F.col("_trap") | has_pattern("_full", "consequence") | has_pattern("_full", "operative_trap")
    base = with_tests(base, {"_substantive": substantive})
    administrative = (
        has_pattern("_full", "governing_law")
        | has_pattern("_full", "notices")
        | has_pattern("_full", "severability")
        | has_pattern("_full", "counterparts")
        | has_pattern("_full", "entire_agreement")
        | has_pattern("_body", "cross_ref_body")
        | (has_pattern("_body", "cross_reference") & ~has_more_words_than(stripped, 39))
        | has_pattern("_full", "boilerplate")
    )
    base = with_tests(base, {"_boilerplate": ~F.col("_substantive") & administrative})

    repeats_title = (ttl != "") & F.startswith(stripped, ttl)
    rest = F.when(repeats_title, strip(F.substring(stripped, F.length("title") + 1, F.length("text")))).otherwise(
        stripped
    )
    base = base.withColumn("_rest", rest)
    bare_heading = (
        (stripped == ttl)
        | (F.col("_rest") == "")
        | (~F.col("_boilerplate") & ~has_more_words_than(F.col("_rest"), 3))
    )
    kind = (
        F.when(has_pattern("_body", "recital") | has_pattern("_ttl", "recital"), "RECITAL")
        .when(
            has_words("_ttl", "definition_title") | matches(stripped, lex.DEFINITION_BODY),
            F.when(F.col("_trap"), "OPERATIVE").otherwise("DEFINITION"),
        )
        .when(
            ~F.col("_trap") & bare_heading & ~matches(F.col("_rest"), lex.OPERATIVE_VERB),
            "HEADING",
        )
        .when(F.col("_substantive"), "OPERATIVE")
        .when(F.col("_boilerplate"), "BOILERPLATE")
        .otherwise("OPERATIVE")
    )
    return (
        with_tests(base, {"clause_kind": kind})
        .withColumn("is_risk_bearing", (F.col("clause_kind") == "OPERATIVE") | F.col("_trap"))
        .drop("_rest")
    )


def is_operative() -> Column:
    """R4, over the helper flags of ``with_structure``."""
    return F.col("_substantive") | (has_pattern("_full", "covenant_verb") & ~F.col("_boilerplate"))


# -- R7: mitigation ---------------------------------------------------------
def mitigation(body: Column | str = "_body") -> dict[str, Column]:
    return {
        "has_cap": has_pattern(body, "cap"),
        "has_mutuality": has_pattern(body, "reciprocal"),
        "has_condition": has_pattern(body, "payment_condition"),
        "has_cure_period": has_pattern(body, "cure"),
    }


def mitigation_flags(clauses: DataFrame) -> DataFrame:
    """Four flags per clause and how many of them hold."""
    flags = mitigation()
    out = with_lowered(clauses).select("doc_id", "idx", *[flags[m].cast("bigint").alias(m) for m in MITIGATIONS])
    return out.withColumn("mitigation_count", sum((F.col(m) for m in MITIGATIONS), F.lit(0).cast("bigint")))


# -- R8-R17: one Column builder per rule, each yielding a rule code or null --
class ClauseView:
    """Columns a rule may look at."""

    def __init__(self):
        self.body, self.title = F.col("_body"), F.col("_ttl")
        self.negated, self.reciprocal = F.col("_negated"), F.col("_reciprocal")
        self.mitigated = {m: F.col("_own_" + m) for m in MITIGATIONS}

    def says(self, words: str) -> Column:
        return has_words("_body", words)

    def reads(self, pattern: str) -> Column:
        return matches(self.body, pattern)


def negation_rule(c: ClauseView) -> Column:
    return F.when(
        c.negated,
        F.when(c.says("no_indemnity"), "no_indemnity")
        .when(
            c.says("bilateral"),
            F.when(F.contains(c.body, F.lit("terminate")), "bilateral_exit").otherwise("bilateral_other"),
        )
        .when(c.reciprocal & c.says("disclaimer"), "mutual_disclaimer"),
    )


def precedence_rule(c: ClauseView) -> Column:
    conflict = c.says("precedence_phrase") | (c.says("precedence_document") & c.says("precedence_conflict"))
    return F.when(c.says("precedence_outcome") & conflict, "precedence")  # three words rule most clauses out


def indemnity_rule(c: ClauseView) -> Column:
    cap = c.mitigated["has_cap"]
    any_mitigation = cap | c.mitigated["has_mutuality"] | c.mitigated["has_condition"] | c.mitigated["has_cure_period"]
    return F.when(
        c.says("indemnity"),
        F.when(c.negated, "indemnity_negated")
        .when(c.reciprocal, "indemnity_mutual")
        .when(
            c.says("uncapped"),
            F.when(~any_mitigation, "indemnity_uncapped")
            .when(cap, "indemnity_capped")
            .otherwise(EASED),
        )
        .otherwise("indemnity_one_sided"),
    )


def ip_rule(c: ClauseView) -> Column:
    paid = c.says("ip_paid")
    return F.when(
        c.says("ip"),
        F.when(F.contains(c.title, F.lit("background ip")) | F.contains(c.body, F.lit("pre-existing")), "ip_background")
        .when(
            c.says("ip_assignment"),
            F.when(c.says("ip_unconditional") | (~paid & c.says("ip_strong")), "ip_unpaid")
            .when(paid, "ip_paid")
            .otherwise("ip_unconditioned"),
        )
        .otherwise("ip_standard"),
    )


def term_rule(c: ClauseView) -> Column:
    duration = (
        F.col("_term_duration") & ~F.col("_renewal") & ~has_pattern("_body", "termination_covenant")
    )
    return F.when(
        duration,
        F.when(c.says("term_forfeiture"), "term_forfeiture")
        .when(c.reads(lex.UNILATERAL_EXTENSION), "term_extension")
        .when(c.says("term_extension_word") & c.reads(lex.RATE_FREEZE), "term_rate_freeze")
        .otherwise("term_standard"),
    )


def renewal_rule(c: ClauseView) -> Column:
    long_notice = (
        c.says("renewal_notice_word") & c.says("renewal_auto_word") & c.reads(lex.LONG_NOTICE)
    )
    return F.when(
        F.col("_renewal"),
        F.when(c.reads(lex.UNILATERAL_EXTENSION), "renewal_unilateral")
        .when(c.says("renewal_forfeiture"), "renewal_forfeiture")
        .when(long_notice | (~c.reciprocal & c.reads(lex.CONTRACTOR_NOTICE)), "renewal_notice")
        .otherwise("renewal_customary"),
    )


def termination_rule(c: ClauseView) -> Column:
    cure = c.mitigated["has_cure_period"]
    return F.when(
        has_pattern("_body", "termination_covenant"),
        F.when(c.negated, "exit_negated")
        .when(
            c.says("exit_kill") | c.says("exit_forfeiture"),
            F.when(cure, "exit_with_notice").otherwise("exit_forfeiture"),
        )
        .when(~c.reciprocal & c.reads(lex.ONE_SIDED_CONVENIENCE), "exit_convenience")
        .when(c.reciprocal | c.says("exit_mutual") | cure, "exit_mutual")
        .otherwise("exit_standard"),
    )


def payment_rule(c: ClauseView) -> Column:
    strained = c.says("payment_delay") | c.says("payment_withholding")
    return F.when(c.says("payment"), F.when(strained, "payment_delayed").otherwise("payment_standard"))


def tenancy_rule(c: ClauseView) -> Column:
    return F.when(
        c.says("tenancy"),
        F.when(c.says("tenancy_entry"), "tenancy_entry")
        .when(c.says("tenancy_deposit"), "tenancy_deposit")
        .otherwise("tenancy_standard"),
    )


def default_rule(c: ClauseView) -> Column:
    dispute = c.says("dispute_body") | has_words("_ttl", "dispute_title")
    return F.when(dispute, "default_dispute").otherwise("default_other")


RULES = {
    "R8": negation_rule,
    "R9": precedence_rule,
    "R10": indemnity_rule,
    "R11": ip_rule,
    "R12": term_rule,
    "R13": renewal_rule,
    "R14": termination_rule,
    "R15": payment_rule,
    "R16": tenancy_rule,
    "R17": default_rule,
}


def with_rule_flags(structured: DataFrame) -> DataFrame:
    """Flags that several rules share; the rest is evaluated lazily inside the decision."""
    return with_tests(
        structured,
        {
            "_negated": has_pattern("_body", "negation"),
            "_term_duration": has_pattern("_body", "term_duration"),
            "_renewal": has_pattern("_body", "renewal_covenant"),
            **{"_own_" + name: flag for name, flag in mitigation().items()},
        },
    ).withColumn("_reciprocal", F.col("_own_has_mutuality"))


#: Code of an uncapped indemnity that something else than a cap mitigates: one-sided, unless it inherits a cap.
EASED = "indemnity_eased"


def settled(code: Column, inherited: dict[str, Column] | None = None) -> Column:
    """The rule that holds, given the code of a clause alone and what it inherits (flags by the names of MITIGATIONS)."""
    alone = F.replace(code, F.lit(EASED), F.lit("indemnity_one_sided"))
    if inherited is None:
        return alone
    some = reduce(or_, inherited.values())
    return (
        F.when(code.isin("indemnity_uncapped", EASED) & inherited["has_cap"], "indemnity_capped")
        .when((code == "indemnity_uncapped") & some, "indemnity_one_sided")
        .when((code == "exit_forfeiture") & inherited["has_cure_period"], "exit_with_notice")
        .when((code == "exit_standard") & inherited["has_cure_period"], "exit_mutual")
        .otherwise(alone)
    )


def decision() -> Column:
    """Structural outcome first, then the rules in order of precedence; the code of a clause alone."""
    view = ClauseView()
    return F.when(~F.col("is_risk_bearing"), F.concat(F.lit("kind_"), F.lower("clause_kind"))).otherwise(
        F.coalesce(*[rule(view) for rule in RULES.values()])
    )


def single_rule(clauses: DataFrame, rule_id: str) -> DataFrame:
    """Outcome of one rule over all clauses it applies to, whatever other rules say."""
    flagged = with_rule_flags(with_lowered(clauses))
    decided = flagged.withColumn("rule", settled(RULES[rule_id](ClauseView())))
    return with_outcome(decided.where(F.col("rule").isNotNull()))


# -- outcome dimension ------------------------------------------------------
def _outcome_map() -> str:
    """The dimension as one SQL map literal, rule code to outcome."""
    entries = []
    for code, o in OUTCOMES.items():
        pushback = sql_literal(o.pushback) if o.pushback else "CAST(NULL AS STRING)"
        reasons = "CAST(array(" + ", ".join(sql_literal(r) for r in o.reasons) + ") AS ARRAY<STRING>)"
        entries.append(
            f"{sql_literal(code)}, named_struct('category', {sql_literal(o.category)}, 'risk_level', "
            f"{sql_literal(o.level)}, 'unfairness', {o.score}, 'summary', {sql_literal(o.summary)}, "
            f"'pushback', {pushback}, 'risk_reasons', {reasons})"
        )
    return "map(" + ", ".join(entries) + ")"


OUTCOME_FIELDS = ["category", "risk_level", "unfairness", "summary", "pushback", "risk_reasons"]
STRUCTURE_FIELDS = ["clause_kind", "is_risk_bearing"]


def with_outcome(decided: DataFrame) -> DataFrame:
    """Looks the rule code up in a constant map and spreads the outcome into columns.

    The columns come out of a generator on purpose: a later filter on them then stays above the decision,
    instead of being rewritten into further copies of the whole rule expression below it.
    """
    looked_up = decided.withColumn("_o", F.element_at(F.expr(_outcome_map()), F.col("rule")))
    kept = [c for c in STRUCTURE_FIELDS if c in decided.columns]
    verdict = F.struct(*kept, *[F.col("_o." + f).alias(f) for f in OUTCOME_FIELDS])
    others = [c for c in decided.columns if c not in kept]
    return looked_up.select(*others, F.inline(F.array(verdict)))


def evaluate_clauses(clauses: DataFrame) -> DataFrame:
    """R18 without cross-references: every clause is judged alone."""
    decided = with_tests(with_rule_flags(with_structure(clauses)), {"rule": settled(decision())})
    return with_outcome(decided).select(*ASSESSED, "rule")


# -- F7: triple gate --------------------------------------------------------
def passes_triple_gate() -> Column:
    """Material consequence, imbalance and lack of mitigation, over ``_body`` and ``_full``."""
    body = F.col("_body")

    def says(name: str) -> Column:
        return has_words("_body", name)

    consequence = (
        says("gate_consequence")
        | (says("gate_renew") & says("gate_renew_how"))
        | (says("gate_exit") & says("gate_exit_how"))
        | (says("gate_pay") & says("gate_pay_how"))
        | has_pattern("_full", "operative_trap")
    )
    own = mitigation()
    imbalance = ~own["has_mutuality"] | matches(body, lex.UNILATERAL_WORDING)
    unmitigated = (
        ~own["has_cap"]
        & ~own["has_mutuality"]
        & ~(F.contains(body, F.lit("assign")) & own["has_condition"])
        & ~(says("gate_exit") & own["has_cure_period"])
    )
    return consequence & imbalance & unmitigated
