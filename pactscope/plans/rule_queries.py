"""Registered queries over the scored corpus: rules, references, predicates, aggregates, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pactscope.functions.text import flag
from pactscope.functions.wording import COUNTER_TEXTS, RELATION_TEXTS, SCENARIO_PROMPTS
from pactscope.functions import lexicon as lex
from pactscope.operators import labels, predicates, ranking, rules, score, xref
from pactscope.plans import oracle_core as oc
from pactscope.sources import corpus

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where there is one, the SQL it is checked against."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = "WITH " + sql.strip()
        return fn

    return register


def assessed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return xref.evaluate_documents(corpus.clauses(spark, sf_dir))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.overall_fairness(assessed(spark, sf_dir), corpus.contracts(spark, sf_dir))


def _keys():
    return [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("idx").cast("bigint").alias("idx")]


# -- flagship ---------------------------------------------------------------
@query(
    "a1_least_fair_contracts",
    oc.ASSESSED + f" SELECT * FROM {oc.fairness_of('asd')} ORDER BY fairness, high_count DESC, doc_id LIMIT 20",
)
def least_fair(spark, sf_dir):
    return score.least_fair(scores(spark, sf_dir))


# -- R1-R7 ------------------------------------------------------------------
_FULL = set(rules._TITLE_AND_TEXT)


def _flag_sql(name: str) -> str:
    if name in _FULL:
        hit = oc.pat("full_", name)
    elif name in ("recital", "clause_label"):
        hit = f"({oc.pat('body', name)} OR {oc.pat('ttl', name)})"
    else:
        hit = oc.pat("body", name)
    return f"CAST({hit} AS BIGINT) AS {name}"


@query("r1_pattern_flags", oc.FLAGS + " SELECT doc_id, idx, " + ", ".join(_flag_sql(n) for n in lex.PATTERNS) + " FROM lo")
def r1(spark, sf_dir):
    out = rules.pattern_flags(corpus.clauses(spark, sf_dir))
    return out.select(*_keys(), *lex.PATTERNS)


@query(
    "r1_pattern_flags_all_templates",
    oc.over_all_templates(oc.FLAGS) + " SELECT doc_id, idx, " + ", ".join(_flag_sql(n) for n in lex.PATTERNS) + " FROM lo",
)
def r1_all(spark, sf_dir):
    """Over templates that reach every pattern."""
    out = rules.pattern_flags(corpus.clauses(spark, sf_dir, corpus.ALL_TEMPLATES))
    return out.select(*_keys(), *lex.PATTERNS)


@query("r2_classify_kind", oc.FLAGS + " SELECT doc_id, idx, clause_kind FROM kb")
def r2(spark, sf_dir):
    return rules.with_structure(corpus.clauses(spark, sf_dir)).select(*_keys(), "clause_kind")


@query("r3_is_pure_boilerplate", oc.FLAGS + " SELECT doc_id, idx, CAST(pure_bp AS BIGINT) AS pure_boilerplate FROM kb")
def r3(spark, sf_dir):
    out = rules.with_structure(corpus.clauses(spark, sf_dir))
    return out.select(*_keys(), flag(F.col("_boilerplate")).alias("pure_boilerplate"))


@query(
    "r4_is_operative",
    oc.FLAGS + " SELECT doc_id, idx, CAST(substantive OR (covenant AND NOT pure_bp) AS BIGINT) AS operative FROM kb",
)
def r4(spark, sf_dir):
    out = rules.with_structure(corpus.clauses(spark, sf_dir))
    return out.select(*_keys(), flag(rules.is_operative()).alias("operative"))


@query(
    "r5_determine_risk_bearing",
    oc.FLAGS + " SELECT doc_id, idx, clause_kind, CAST(is_risk_bearing AS BIGINT) AS risk_bearing FROM kb",
)
def r5(spark, sf_dir):
    out = rules.with_structure(corpus.clauses(spark, sf_dir))
    return out.select(*_keys(), "clause_kind", flag(F.col("is_risk_bearing")).alias("risk_bearing"))


@query(
    "r6_non_risk_assessment",
    oc.ALONE + """ SELECT doc_id, idx, clause_kind, category, risk_level, CAST(unfairness AS BIGINT) AS unfairness,
      summary FROM asd WHERE NOT is_risk_bearing""",
)
def r6(spark, sf_dir):
    structured = rules.with_structure(corpus.clauses(spark, sf_dir))
    out = rules.with_outcome(structured.withColumn("rule", F.concat(F.lit("kind_"), F.lower("clause_kind"))))
    return out.where(~F.col("is_risk_bearing")).select(
        *_keys(), "clause_kind", "category", "risk_level", F.col("unfairness").cast("bigint").alias("unfairness"), "summary"
    )


@query(
    "r7_mitigation_flags",
    oc.FLAGS + """ SELECT doc_id, idx, CAST(cap AS BIGINT) AS has_cap, CAST(recip AS BIGINT) AS has_mutuality,
      CAST(cond AS BIGINT) AS has_condition, CAST(cure AS BIGINT) AS has_cure_period,
      CAST(cap AS BIGINT) + CAST(recip AS BIGINT) + CAST(cond AS BIGINT) + CAST(cure AS BIGINT) AS mitigation_count
      FROM kb""",
)
def r7(spark, sf_dir):
    out = rules.mitigation_flags(corpus.clauses(spark, sf_dir))
    return out.select(*_keys(), *rules.MITIGATIONS, "mitigation_count")


# -- R8-R17: each rule on its own -------------------------------------------
_RULE_NAMES = {
    "R8": "r8_negation_rule", "R9": "r9_precedence_rule", "R10": "r10_indemnity_rule", "R11": "r11_ip_rule",
    "R12": "r12_term_rule", "R13": "r13_renewal_rule", "R14": "r14_termination_rule", "R15": "r15_payment_rule",
    "R16": "r16_tenancy_rule", "R17": "r17_default_rule",
}


def _register_rule(rule_id: str, name: str) -> None:
    sql = oc.FLAGS + f""", {oc.OUTCOME},
      own AS (SELECT *, cap AS mcap, recip AS mmut, cond AS mcond, cure AS mcure FROM fl)
      SELECT doc_id, idx, rule, category, risk_level, CAST(unfairness AS BIGINT) AS unfairness,
        array_to_string(risk_reasons, '; ') AS reasons
      FROM (SELECT *, {oc.RULE_SQL[rule_id]} AS rule FROM own) JOIN outcome USING (rule)"""

    @query(name, oc.over_all_templates(sql))
    def run(spark, sf_dir):
        out = rules.single_rule(corpus.clauses(spark, sf_dir, corpus.ALL_TEMPLATES), rule_id)
        return out.select(
            *_keys(), "rule", "category", "risk_level", F.col("unfairness").cast("bigint").alias("unfairness"),
            F.array_join("risk_reasons", "; ").alias("reasons"),
        )


for _id, _name in _RULE_NAMES.items():
    _register_rule(_id, _name)

_ASSESSMENT_SQL = """ SELECT doc_id, idx, clause_kind, CAST(is_risk_bearing AS BIGINT) AS risk_bearing, rule, category,
  risk_level, CAST(unfairness AS BIGINT) AS unfairness, summary, coalesce(pushback, '') AS pushback,
  array_to_string(risk_reasons, '; ') AS reasons FROM asd"""


def _assessment(df):
    return df.select(
        *_keys(), "clause_kind", flag(F.col("is_risk_bearing")).alias("risk_bearing"), "rule", "category", "risk_level",
        F.col("unfairness").cast("bigint").alias("unfairness"), "summary",
        F.coalesce("pushback", F.lit("")).alias("pushback"), F.array_join("risk_reasons", "; ").alias("reasons"),
    )


@query("r18_evaluate_clause", oc.ALONE + _ASSESSMENT_SQL)
def r18(spark, sf_dir):
    return _assessment(rules.evaluate_clauses(corpus.clauses(spark, sf_dir)))


@query("r19_evaluate_documents", oc.ASSESSED + _ASSESSMENT_SQL)
def r19(spark, sf_dir):
    return _assessment(assessed(spark, sf_dir))


@query("r19_evaluate_documents_all_templates", oc.over_all_templates(oc.ASSESSED) + _ASSESSMENT_SQL)
def r19_all(spark, sf_dir):
    """Over templates that reach every rule and every outcome."""
    return _assessment(xref.evaluate_documents(corpus.clauses(spark, sf_dir, corpus.ALL_TEMPLATES)))


# -- R20-R25 ----------------------------------------------------------------
_FAMILY_SQL = "CASE " + " ".join(
    f"WHEN {oc.any_of('said', words)} THEN {oc.q(COUNTER_TEXTS[name])}" for name, words in lex.COUNTER_FAMILIES
) + f" ELSE {oc.q(COUNTER_TEXTS['default'])} END"


@query(
    "r20_counter_proposal",
    oc.ASSESSED + f""" SELECT doc_id, idx, CASE WHEN length({oc.pystrip('pushback')}) > 10
      THEN {oc.pystrip('pushback')} ELSE {_FAMILY_SQL} END AS counter_proposal
      FROM (SELECT *, lower(title || ' ' || text || ' ' || array_to_string(risk_reasons, ' ')) AS said FROM asd)""",
)
def r20(spark, sf_dir):
    return assessed(spark, sf_dir).select(*_keys(), labels.counter_proposal().alias("counter_proposal"))


@query(
    "r21_normalize_category",
    oc.ASSESSED + """ SELECT doc_id, idx, CASE WHEN contains(category, 'TERMINAT') THEN 'TERMINATION'
      WHEN contains(category, 'LIABIL') OR contains(category, 'INDEMN') THEN 'LIABILITY'
      WHEN contains(category, 'IP') OR contains(category, 'INTELLECTUAL') OR contains(category, 'PROPERT') THEN 'IP_RIGHTS'
      WHEN contains(category, 'PAY') OR contains(category, 'FEE') THEN 'PAYMENT'
      WHEN contains(category, 'DISPUT') OR contains(category, 'ARBITRAT') THEN 'DISPUTE' ELSE 'MISC' END AS display_category
      FROM asd""",
)
def r21(spark, sf_dir):
    out = assessed(spark, sf_dir)
    return out.select(*_keys(), labels.normalize_category(F.col("category")).alias("display_category"))


@query(
    "r22_normalize_risk_level",
    """ SELECT o_orderkey AS doc_id, CASE WHEN upper(split_part(o_orderpriority, '-', 2)) IN
      ('HIGH', 'MEDIUM', 'LOW', 'NEUTRAL') THEN upper(split_part(o_orderpriority, '-', 2)) ELSE 'LOW' END AS risk_level
      FROM orders""".replace("SELECT", "x AS (SELECT 1) SELECT", 1),
)
def r22(spark, sf_dir):
    raw = F.lower(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))
    return corpus.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), labels.normalize_risk_level(raw).alias("risk_level")
    )


@query(
    "r23_fairness_band",
    oc.ASSESSED + f""" SELECT doc_id, fairness,
      CASE WHEN fairness >= 75 THEN 'FAIR' WHEN fairness >= 50 THEN 'MODERATE' ELSE 'HIGH_RISK' END AS band,
      CASE WHEN fairness >= 75 THEN 'Fair and balanced: ordinary terms'
        WHEN fairness >= 50 THEN 'Moderate risk: ' || CAST(medium_count AS BIGINT) || ' one-sided clause'
          || CASE WHEN medium_count = 1 THEN '' ELSE 's' END
        WHEN high_count > 0 THEN 'High risk: ' || CAST(high_count AS BIGINT) || ' severe clause'
          || CASE WHEN high_count = 1 THEN '' ELSE 's' END
        ELSE 'High risk: terms lean to one side' END AS headline,
      CASE WHEN fairness < 50 THEN 'High Risk' WHEN fairness < 75 THEN 'Moderate' ELSE 'Balanced' END AS verdict
      FROM {oc.fairness_of('asd')}""",
)
def r23(spark, sf_dir):
    return labels.fairness_band(scores(spark, sf_dir))


_FAMILY_OF = """CASE WHEN contains(lower(filename), 'lease') OR contains(lower(filename), 'tenan')
    OR contains(lower(filename), 'apartment') THEN 'lease'
  WHEN contains(lower(filename), 'nda') OR contains(lower(filename), 'confidential') THEN 'nda' ELSE 'services' END"""
_PROMPT_ROWS = ", ".join(
    f"({oc.q(fam)}, {i}, {oc.q(a)}, {oc.q(b)})"
    for fam, rows in SCENARIO_PROMPTS.items() for i, (a, b) in enumerate(rows, 1)
)


@query(
    "r24_contract_family",
    oc.CONTRACTS.strip() + f""", prompts(family, ord, prompt_id, prompt) AS (VALUES {_PROMPT_ROWS})
      SELECT doc_id, family, CAST(ord AS BIGINT) AS ord, prompt_id, prompt
      FROM (SELECT doc_id, {_FAMILY_OF} AS family FROM contracts) JOIN prompts USING (family)""",
)
def r24(spark, sf_dir):
    return labels.scenario_prompts(corpus.contracts(spark, sf_dir))


@query(
    "r25_material_risk_report",
    oc.ASSESSED + f""", top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {oc.RANK_ORDER}) AS rn,
        lower(title || ' ' || text || ' ' || array_to_string(risk_reasons, ' ')) AS said
        FROM asd WHERE {oc.MATERIAL} QUALIFY rn <= 7),
      n AS (SELECT doc_id, count(*) AS n FROM asd WHERE {oc.MATERIAL} GROUP BY doc_id)
      SELECT c.doc_id, CAST(coalesce(rn, 0) AS BIGINT) AS ord, coalesce(title, 'none') AS title,
        coalesce(risk_level, '') AS risk_level, coalesce(summary, '') AS summary,
        coalesce('[CITE:' || clause_id || ']', '') AS citation,
        CASE WHEN rn = 1 THEN CASE WHEN length(pushback) > 10 THEN pushback ELSE {_FAMILY_SQL} END ELSE '' END
          AS counter_proposal,
        CAST(coalesce(n.n, 0) AS BIGINT) AS n_material, CAST(greatest(0, 5 - coalesce(n.n, 0)) AS BIGINT) AS missing_of_asked
      FROM contracts c LEFT JOIN top ON top.doc_id = c.doc_id LEFT JOIN n ON n.doc_id = c.doc_id""",
)
def r25(spark, sf_dir):
    return ranking.material_risk_report(assessed(spark, sf_dir), corpus.contracts(spark, sf_dir))


# -- X1-X4 ------------------------------------------------------------------
@query(
    "x1_build_label_index",
    oc.REFS + """ SELECT doc_id, label, idx AS dst_idx, CAST(cap AS BIGINT) AS has_cap, CAST(recip AS BIGINT) AS has_mutuality,
      CAST(cond AS BIGINT) AS has_condition, CAST(cure AS BIGINT) AS has_cure_period FROM label_index""",
)
def x1(spark, sf_dir):
    out = xref.build_label_index(corpus.clauses(spark, sf_dir))
    return out.select(
        "doc_id", "label", F.col("dst_idx").cast("bigint").alias("dst_idx"), *[flag(F.col(m)).alias(m) for m in rules.MITIGATIONS]
    )


@query("x2_resolve_references", oc.REFS + " SELECT doc_id, src_idx, dst_idx, label FROM edges WHERE src_idx <> dst_idx")
def x2(spark, sf_dir):
    out = xref.resolve_references(corpus.clauses(spark, sf_dir))
    return out.select(
        "doc_id", F.col("src_idx").cast("bigint").alias("src_idx"), F.col("dst_idx").cast("bigint").alias("dst_idx"), "label"
    )


_VERB_SQL = "CASE relation " + " ".join(f"WHEN '{k}' THEN {oc.q(v)}" for k, v in RELATION_TEXTS.items()) + " END"


@query(
    "x3_reference_relation",
    oc.over_all_templates(oc.REFS) + f""" SELECT doc_id, src_idx, dst_idx, relation,
      'This clause ' || {_VERB_SQL} || ' Section ' || label AS explanation FROM edges WHERE src_idx <> dst_idx""",
)
def x3(spark, sf_dir):
    """Over templates that reach every relation."""
    out = xref.explain_references(xref.resolve_references(corpus.clauses(spark, sf_dir, corpus.ALL_TEMPLATES)))
    return out.select(
        "doc_id", F.col("src_idx").cast("bigint").alias("src_idx"), F.col("dst_idx").cast("bigint").alias("dst_idx"),
        "relation", "explanation",
    )


@query(
    "x4_propagate_mitigation",
    oc.REFS + """ SELECT doc_id, idx, CAST(icap AS BIGINT) AS in_has_cap, CAST(imut AS BIGINT) AS in_has_mutuality,
      CAST(icond AS BIGINT) AS in_has_condition, CAST(icure AS BIGINT) AS in_has_cure_period FROM inherited""",
)
def x4(spark, sf_dir):
    out = xref.propagate_mitigation(corpus.clauses(spark, sf_dir))
    return out.select(*_keys(), *[flag(F.col("in_" + m)).alias("in_" + m) for m in rules.MITIGATIONS])


# -- F1-F7 ------------------------------------------------------------------
@query("f1_is_risk_bearing", oc.ASSESSED + f" SELECT doc_id, idx, CAST({oc.BEARING} AS BIGINT) AS bearing FROM asd")
def f1(spark, sf_dir):
    return assessed(spark, sf_dir).select(*_keys(), flag(predicates.is_risk_bearing()).alias("bearing"))


@query("f2_is_risk_bearing_display", oc.ASSESSED + f" SELECT doc_id, idx, CAST({oc.SHOWN} AS BIGINT) AS bearing FROM asd")
def f2(spark, sf_dir):
    return assessed(spark, sf_dir).select(*_keys(), flag(predicates.is_risk_bearing_for_display()).alias("bearing"))


@query("f3_is_materially_risky", oc.ASSESSED + f" SELECT doc_id, idx, risk_level FROM asd WHERE {oc.MATERIAL}")
def f3(spark, sf_dir):
    return assessed(spark, sf_dir).where(predicates.is_materially_risky()).select(*_keys(), "risk_level")




@query(
    "f4_is_global_risk_query",
    oc.QUESTION_VALUES + f""", asked AS (
        SELECT conv_id, turn, CASE (conv_id + turn) % 3 WHEN 0 THEN q.message WHEN 1 THEN coalesce(text, '')
          ELSE coalesce(text, '') || ' ' || q.message END AS message
        FROM conversations c JOIN question q ON q.q_id = (c.conv_id + c.turn) % {len(corpus.QUESTIONS)})
      SELECT conv_id, turn, CAST({oc.global_question('message')} AS BIGINT) AS is_global FROM asked""",
)
def f4(spark, sf_dir):
    questions = F.array(*[F.lit(m) for m in corpus.QUESTIONS])
    at = F.col("conv_id") + F.col("turn")
    picked, said = F.get(questions, (at % len(corpus.QUESTIONS)).cast("int")), F.coalesce("text", F.lit(""))
    message = F.when(at % 3 == 0, picked).when(at % 3 == 1, said).otherwise(F.concat(said, F.lit(" "), picked))
    return corpus.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", flag(predicates.is_global_risk_question(message)).alias("is_global")
    )


@query("f5_risk_filter", oc.ASSESSED + " SELECT doc_id, idx, title FROM asd WHERE risk_level = 'HIGH'")
def f5(spark, sf_dir):
    return predicates.risk_filter(assessed(spark, sf_dir), "HIGH").select(*_keys(), "title")


@query(
    "f6_category_filter",
    oc.ASSESSED + """ SELECT doc_id, idx, title, risk_level FROM asd
      WHERE category = 'TERMINATION' AND contains(lower(title || chr(10) || text), 'notice')""",
)
def f6(spark, sf_dir):
    out = predicates.clause_list(assessed(spark, sf_dir), category="TERMINATION", search="Notice", by_risk=True)
    return out.select(*_keys(), "title", "risk_level")


GATE_SQL = f"""(({oc.says('body', 'gate_consequence')} OR trap_full
    OR ({oc.says('body', 'gate_renew')} AND {oc.says('body', 'gate_renew_how')})
    OR ({oc.says('body', 'gate_exit')} AND {oc.says('body', 'gate_exit_how')})
    OR ({oc.says('body', 'gate_pay')} AND {oc.says('body', 'gate_pay_how')}))
  AND ({oc.rx('body', lex.UNILATERAL_WORDING)} OR NOT recip)
  AND NOT (cap OR recip) AND NOT (contains(body, 'assign') AND cond)
  AND NOT ((contains(body, 'terminate') OR contains(body, 'termination')) AND cure))"""


@query("f7_passes_triple_gate", oc.FLAGS + f" SELECT doc_id, idx, CAST({GATE_SQL} AS BIGINT) AS passes FROM fl")
def f7(spark, sf_dir):
    out = rules.with_lowered(corpus.clauses(spark, sf_dir))
    return out.select(*_keys(), flag(rules.passes_triple_gate()).alias("passes"))


# -- A1-A5, A10 -------------------------------------------------------------
@query("a1_overall_fairness", oc.ASSESSED + f" SELECT * FROM {oc.fairness_of('asd')}")
def a1(spark, sf_dir):
    return scores(spark, sf_dir)


@query(
    "a2_risk_counts",
    oc.ASSESSED + """ SELECT doc_id, count(*) FILTER (risk_level = 'HIGH' AND is_risk_bearing) AS high_count,
      count(*) FILTER (risk_level = 'MEDIUM' AND is_risk_bearing) AS medium_count,
      count(*) FILTER (risk_level = 'HIGH') AS high_any, count(*) FILTER (risk_level = 'MEDIUM') AS medium_any
      FROM asd GROUP BY doc_id""",
)
def a2(spark, sf_dir):
    return score.risk_counts(assessed(spark, sf_dir))


@query(
    "a3_risk_distribution",
    oc.ASSESSED + " SELECT doc_id, "
    + ", ".join(f"count(*) FILTER (risk_level = '{lv}') AS {lv.lower()}_count" for lv in lex.RISK_ORDINAL)
    + ", count(*) AS total_clauses FROM asd GROUP BY doc_id",
)
def a3(spark, sf_dir):
    return score.risk_distribution(assessed(spark, sf_dir))


@query(
    "a4_category_summary",
    oc.ASSESSED + f""" SELECT doc_id, category, count(*) AS clause_count,
      CASE max({oc.ordinal('risk_level')}) WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'NEUTRAL' END
      AS highest_risk FROM asd GROUP BY doc_id, category""",
)
def a4(spark, sf_dir):
    return score.category_summary(assessed(spark, sf_dir))


@query(
    "a5_risk_pages",
    oc.ASSESSED + """ SELECT DISTINCT doc_id, CAST(page_no AS BIGINT) AS page_no FROM asd
      WHERE risk_level = 'HIGH' AND is_risk_bearing""",
)
def a5(spark, sf_dir):
    return score.risk_pages(assessed(spark, sf_dir))


@query(
    "a10_portfolio_rollup",
    oc.ASSESSED + """ SELECT CASE WHEN grouping(category) = 1 THEN 'ALL' ELSE category END AS category,
      CASE WHEN grouping(risk_level) = 1 THEN 'ALL' ELSE risk_level END AS risk_level,
      count(*) AS clause_count, count(DISTINCT doc_id) AS contract_count,
      round(sum(unfairness)::DOUBLE / count(*), 6) AS mean_unfairness
      FROM asd GROUP BY ROLLUP (category, risk_level)""",
)
def a10(spark, sf_dir):
    return score.portfolio_rollup(assessed(spark, sf_dir))


# -- W1, W7-W9 --------------------------------------------------------------
@query(
    "w1_rank_risk_clauses",
    oc.ASSESSED + f""" SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY {oc.RANK_ORDER}) AS rank, clause_id,
      risk_level, CAST(unfairness AS BIGINT) AS unfairness FROM asd WHERE {oc.MATERIAL} QUALIFY rank <= 7""",
)
def w1(spark, sf_dir):
    out = ranking.rank_risk_clauses(assessed(spark, sf_dir))
    return out.select(
        "doc_id", F.col("rank").cast("bigint").alias("rank"), "clause_id", "risk_level",
        F.col("unfairness").cast("bigint").alias("unfairness"),
    )


@query(
    "w7_first_focus_clause",
    oc.ASSESSED + f""", c AS (SELECT doc_id, clause_id, idx, CASE risk_level WHEN 'HIGH' THEN 1 WHEN 'MEDIUM' THEN 2 ELSE 3 END
        AS tier FROM asd WHERE {oc.SHOWN} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY tier, idx) = 1)
      SELECT d.doc_id, clause_id, CAST(tier AS BIGINT) AS tier FROM contracts d LEFT JOIN c ON c.doc_id = d.doc_id""",
)
def w7(spark, sf_dir):
    return ranking.first_focus_clause(assessed(spark, sf_dir))


@query(
    "w8_headline_risks",
    oc.ASSESSED + f""", s AS (SELECT * FROM asd WHERE {oc.SHOWN}),
      h AS (SELECT doc_id, list(title ORDER BY idx) AS t, list(clause_id ORDER BY idx) AS c FROM s
            WHERE risk_level = 'HIGH' GROUP BY doc_id),
      m AS (SELECT doc_id, list(title ORDER BY idx) AS t, list(clause_id ORDER BY idx) AS c FROM s
            WHERE risk_level = 'MEDIUM' GROUP BY doc_id)
      SELECT d.doc_id, CASE WHEN len(h.t) >= 2 THEN 'SEVERAL_HIGH' WHEN len(h.t) = 1 THEN 'ONE_HIGH'
          WHEN len(m.t) >= 1 THEN 'MEDIUM' ELSE 'NONE' END AS tier,
        CASE WHEN h.t IS NOT NULL THEN array_to_string(h.t[1:2], ' | ') WHEN m.t IS NOT NULL
          THEN array_to_string(m.t[1:2], ' | ') ELSE '' END AS titles,
        CASE WHEN h.t IS NOT NULL THEN array_to_string(h.c, ',') WHEN m.t IS NOT NULL
          THEN array_to_string(m.c[1:2], ',') ELSE '' END AS cited
      FROM contracts d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id""",
)
def w8(spark, sf_dir):
    return ranking.headline_risks(assessed(spark, sf_dir))


@query(
    "w9_applicable_suggestion",
    oc.ASSESSED + """ SELECT doc_id, clause_id AS target_clause_id, pushback AS counter_clause,
      'Replaces one-sided terms of ' || title || ' with mutual, capped ones.' AS rationale
      FROM asd WHERE risk_level = 'HIGH' AND pushback <> '' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) = 1""",
)
def w9(spark, sf_dir):
    return ranking.applicable_suggestion(assessed(spark, sf_dir), ["doc_id"], "idx")
