"""Shared DuckDB CTEs for the checks: corpus, clause flags and assessment.

Written from the rules, not generated from the Spark plans; only fixed values
(patterns, word lists, templates, outcome texts) come from the same tables.
"""

from __future__ import annotations

from pactscope.functions.lexicon import PATTERNS, RISK_ORDINAL, UNILATERAL_EXTENSION, WORDS, WS_CHARS, WS_CLASS
from pactscope.functions import lexicon as lex
from pactscope.functions.wording import OUTCOMES
from pactscope.sources.corpus import ALL_TEMPLATES, QUESTIONS, TEMPLATES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {q(pattern)})"


def pat(column: str, name: str) -> str:
    return rx(column, PATTERNS[name])


def says(column: str, name: str) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in WORDS[name]) + ")"


def any_of(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, {q(w)})" for w in words) + ")"


def pystrip(expr: str) -> str:
    return f"trim({expr}, {q(WS_CHARS)})"


WORDCOUNT = rf"[^{WS_CLASS}]+"


def nwords(expr: str) -> str:
    return f"len(regexp_extract_all({expr}, {q(WORDCOUNT)}))"


def ordinal(column: str) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RISK_ORDINAL.items()) + " ELSE 0 END"


def _values(templates: list[tuple[str, str]]) -> str:
    return ", ".join(f"({i}, {q(t)}, {q(b)})" for i, (t, b) in enumerate(templates))


CONTRACTS = """
contracts AS (
  SELECT o_orderkey AS doc_id, CAST(4 + o_orderkey % 9 AS INTEGER) AS n,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Apartment_Lease_' || o_orderkey || '.pdf'
      WHEN '2-HIGH' THEN 'mutual_nda_' || o_orderkey || '.DOCX'
      WHEN '3-MEDIUM' THEN 'services_agreement_' || o_orderkey || '.pdf'
      WHEN '5-LOW' THEN 'statement_of_work_' || o_orderkey || '.txt'
      ELSE 'price_list_' || o_orderkey || '.xlsx' END AS filename,
    CASE WHEN o_orderstatus = 'P' THEN 0 ELSE CAST(round(o_totalprice * 100) AS BIGINT) END AS size_bytes,
    o_orderstatus AS status
  FROM orders)"""

def _clauses(templates: list[tuple[str, str]]) -> str:
    return (
        f"template(t, ttl, body) AS (VALUES {_values(templates)}),"
        + CONTRACTS
        + """,
cl AS MATERIALIZED (
  SELECT c.doc_id, c.idx, 'clause_' || c.idx AS clause_id, c.idx || '. ' || t.ttl AS title,
         replace(t.body, '{ref}', CAST(1 + (c.doc_id + c.idx) % c.n AS VARCHAR)) AS text, 1 + (c.idx - 1) // 3 AS page_no
  FROM (SELECT doc_id, n, unnest(generate_series(1, n)) AS idx FROM contracts) c
  JOIN template t ON t.t = (c.doc_id * 7 + c.idx * 11) % """ + f"{len(templates)})"
    )


CLAUSES, ALL_CLAUSES = _clauses(TEMPLATES), _clauses(ALL_TEMPLATES)


def over_all_templates(sql: str) -> str:
    """The same SQL over clauses of all templates."""
    return sql.replace(CLAUSES, ALL_CLAUSES)


FLAGS = (
    CLAUSES
    + f""",
lo AS MATERIALIZED (
  SELECT *, lower(text) AS body, {pystrip('lower(title)')} AS ttl, {pystrip("lower(title || chr(10) || text)")} AS full_
  FROM cl),
fl AS MATERIALIZED (
  SELECT *, {pat('body', 'operative_trap')} AS trap, {pat('full_', 'operative_trap')} AS trap_full,
    {pat('full_', 'consequence')} AS consequence, {pat('full_', 'covenant_verb')} AS covenant,
    {pat('body', 'negation')} AS neg, {pat('body', 'reciprocal')} AS recip, {pat('body', 'cap')} AS cap,
    {pat('body', 'payment_condition')} AS cond, {pat('body', 'cure')} AS cure
  FROM lo),
bp AS MATERIALIZED (
  SELECT *, (trap_full OR consequence) AS substantive,
    NOT (trap_full OR consequence) AND (
      {pat('full_', 'governing_law')} OR {pat('full_', 'notices')} OR {pat('full_', 'severability')}
      OR {pat('full_', 'counterparts')} OR {pat('full_', 'entire_agreement')} OR {pat('body', 'cross_ref_body')}
      OR ({pat('body', 'cross_reference')} AND {nwords('body')} < 40) OR {pat('full_', 'boilerplate')}) AS pure_bp,
    CASE WHEN ttl <> '' AND starts_with({pystrip('body')}, ttl)
         THEN {pystrip(f"substr({pystrip('body')}, length(title) + 1)")} ELSE {pystrip('body')} END AS rest
  FROM fl),
kd AS MATERIALIZED (
  SELECT *, CASE
      WHEN {pat('body', 'recital')} OR {pat('ttl', 'recital')} THEN 'RECITAL'
      WHEN {says('ttl', 'definition_title')} OR {rx(pystrip('body'), lex.DEFINITION_BODY)}
        THEN CASE WHEN trap THEN 'OPERATIVE' ELSE 'DEFINITION' END
      WHEN ({pystrip('body')} = ttl OR {nwords('rest')} = 0 OR ({nwords('rest')} <= 3 AND NOT pure_bp))
        AND NOT {rx('rest', lex.OPERATIVE_VERB)} AND NOT trap THEN 'HEADING'
      WHEN substantive OR (covenant AND NOT pure_bp) THEN 'OPERATIVE'
      WHEN pure_bp THEN 'BOILERPLATE'
      ELSE 'OPERATIVE' END AS clause_kind
  FROM bp),
kb AS MATERIALIZED (SELECT *, (clause_kind = 'OPERATIVE' OR trap) AS is_risk_bearing FROM kd)"""
)

# single rules, over any relation with body, ttl, neg, recip and the mitigation flags mcap, mmut, mcond, mcure
RULE_SQL = {
    "R8": f"""CASE WHEN NOT neg THEN NULL WHEN {says('body', 'no_indemnity')} THEN 'no_indemnity'
      WHEN {says('body', 'bilateral')} AND contains(body, 'terminate') THEN 'bilateral_exit'
      WHEN {says('body', 'bilateral')} THEN 'bilateral_other'
      WHEN {says('body', 'disclaimer')} AND recip THEN 'mutual_disclaimer' END""",
    "R9": f"""CASE WHEN ({says('body', 'precedence_phrase')}
        OR ({says('body', 'precedence_document')} AND {says('body', 'precedence_conflict')}))
      AND {says('body', 'precedence_outcome')} THEN 'precedence' END""",
    "R10": f"""CASE WHEN NOT {says('body', 'indemnity')} THEN NULL
      WHEN neg THEN 'indemnity_negated' WHEN recip THEN 'indemnity_mutual'
      WHEN {says('body', 'uncapped')} AND NOT (mcap OR mmut OR mcond OR mcure) THEN 'indemnity_uncapped'
      WHEN {says('body', 'uncapped')} AND mcap THEN 'indemnity_capped' ELSE 'indemnity_one_sided' END""",
    "R11": f"""CASE WHEN NOT {says('body', 'ip')} THEN NULL
      WHEN contains(ttl, 'background ip') OR contains(body, 'pre-existing') THEN 'ip_background'
      WHEN NOT {says('body', 'ip_assignment')} THEN 'ip_standard'
      WHEN {says('body', 'ip_unconditional')} OR (NOT {says('body', 'ip_paid')} AND {says('body', 'ip_strong')})
        THEN 'ip_unpaid'
      WHEN {says('body', 'ip_paid')} THEN 'ip_paid' ELSE 'ip_unconditioned' END""",
    "R12": f"""CASE WHEN NOT ({pat('body', 'term_duration')} AND NOT {pat('body', 'renewal_covenant')}
        AND NOT {pat('body', 'termination_covenant')}) THEN NULL
      WHEN {says('body', 'term_forfeiture')} THEN 'term_forfeiture'
      WHEN {rx('body', UNILATERAL_EXTENSION)} THEN 'term_extension'
      WHEN {rx('body', lex.RATE_FREEZE)} AND {says('body', 'term_extension_word')} THEN 'term_rate_freeze'
      ELSE 'term_standard' END""",
    "R13": f"""CASE WHEN NOT {pat('body', 'renewal_covenant')} THEN NULL
      WHEN {rx('body', UNILATERAL_EXTENSION)} THEN 'renewal_unilateral'
      WHEN {says('body', 'renewal_forfeiture')} THEN 'renewal_forfeiture'
      WHEN ({rx('body', lex.LONG_NOTICE)} AND {says('body', 'renewal_notice_word')}
        AND {says('body', 'renewal_auto_word')}) OR ({rx('body', lex.CONTRACTOR_NOTICE)} AND NOT recip)
        THEN 'renewal_notice' ELSE 'renewal_customary' END""",
    "R14": f"""CASE WHEN NOT {pat('body', 'termination_covenant')} THEN NULL WHEN neg THEN 'exit_negated'
      WHEN {says('body', 'exit_kill')} OR {says('body', 'exit_forfeiture')}
        THEN CASE WHEN mcure THEN 'exit_with_notice' ELSE 'exit_forfeiture' END
      WHEN {rx('body', lex.ONE_SIDED_CONVENIENCE)} AND NOT recip THEN 'exit_convenience'
      WHEN recip OR mcure OR {says('body', 'exit_mutual')} THEN 'exit_mutual' ELSE 'exit_standard' END""",
    "R15": f"""CASE WHEN NOT {says('body', 'payment')} THEN NULL
      WHEN {says('body', 'payment_delay')} OR {says('body', 'payment_withholding')} THEN 'payment_delayed'
      ELSE 'payment_standard' END""",
    "R16": f"""CASE WHEN NOT {says('body', 'tenancy')} THEN NULL
      WHEN {says('body', 'tenancy_entry')} THEN 'tenancy_entry'
      WHEN {says('body', 'tenancy_deposit')} THEN 'tenancy_deposit' ELSE 'tenancy_standard' END""",
    "R17": f"""CASE WHEN {says('body', 'dispute_body')} OR {says('ttl', 'dispute_title')} THEN 'default_dispute'
      ELSE 'default_other' END""",
}


def _list(items: tuple[str, ...]) -> str:
    return "CAST([" + ", ".join(q(i) for i in items) + "] AS VARCHAR[])"


OUTCOME = "outcome(rule, category, risk_level, unfairness, summary, pushback, risk_reasons) AS (VALUES " + ", ".join(
    f"({q(k)}, {q(o.category)}, {q(o.level)}, {o.score}, {q(o.summary)}, "
    f"{q(o.pushback) if o.pushback else 'CAST(NULL AS VARCHAR)'}, {_list(o.reasons)})"
    for k, o in OUTCOMES.items()
) + ")"

_COLS = "doc_id, idx, clause_id, title, text, page_no, clause_kind, is_risk_bearing"
_DECIDE = "CASE WHEN NOT is_risk_bearing THEN 'kind_' || lower(clause_kind) ELSE coalesce(" + ", ".join(
    f"({RULE_SQL[r]})" for r in RULE_SQL
) + ") END"

ALONE = (
    FLAGS
    + f""", {OUTCOME},
own AS (SELECT *, cap AS mcap, recip AS mmut, cond AS mcond, cure AS mcure FROM kb),
asd AS MATERIALIZED (
  SELECT {_COLS}, rule, category, risk_level, unfairness, summary, pushback, risk_reasons
  FROM (SELECT *, {_DECIDE} AS rule FROM own) JOIN outcome USING (rule))"""
)

EDGES = f"""
labels AS (
  SELECT doc_id, idx, clause_id, cap, recip, cond, cure,
    coalesce(nullif(regexp_extract(ttl, {q(PATTERNS['clause_label'])}, 1), ''),
             nullif(regexp_extract(substr({pystrip('body')}, 1, 60), {q(PATTERNS['clause_label'])}, 1), '')) AS label
  FROM kb),
label_index AS MATERIALIZED (
  SELECT * FROM labels WHERE label IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY doc_id, label ORDER BY idx) = 1),
mention AS (
  SELECT doc_id, idx, body, unnest(m) AS label, generate_subscripts(m, 1) AS pos
  FROM (SELECT *, regexp_extract_all(body, {q(PATTERNS['reference_mention'])}, 1) AS m FROM kb)),
first_mention AS (
  SELECT doc_id, idx, any_value(body) AS body, label, min(pos) AS pos FROM mention GROUP BY doc_id, idx, label),
win AS (
  SELECT *, coalesce(nullif(regexp_extract(body,
      '(?:.{{0,80}})?\\b(?:section|clause|article|subsection|paragraph)\\s+' || replace(label, '.', '\\.')
      || '\\b(?:.{{0,80}})?'), ''), body) AS w
  FROM first_mention),
edges AS MATERIALIZED (
  SELECT s.doc_id, s.idx AS src_idx, t.idx AS dst_idx, s.label, t.cap, t.recip, t.cond, t.cure,
    CASE WHEN {says('w', 'reference_overrides')} THEN 'overrides'
      WHEN {says('w', 'reference_limits')} THEN CASE WHEN t.cap OR t.cure OR t.recip THEN 'mitigates' ELSE 'limits' END
      WHEN {says('w', 'reference_expands')} THEN 'expands' ELSE 'unrelated' END AS relation
  FROM win s JOIN label_index t ON s.doc_id = t.doc_id AND s.label = t.label),
inherited AS MATERIALIZED (
  SELECT doc_id, src_idx AS idx, bool_or(cap) AS icap, bool_or(recip) AS imut, bool_or(cond) AS icond,
         bool_or(cure) AS icure
  FROM edges WHERE relation IN ('mitigates', 'limits') GROUP BY ALL)"""

REFS = FLAGS + "," + EDGES

ASSESSED = (
    REFS
    + f""", {OUTCOME},
eff AS (
  SELECT kb.*, cap OR coalesce(icap, FALSE) AS mcap, recip OR coalesce(imut, FALSE) AS mmut,
    cond OR coalesce(icond, FALSE) AS mcond, cure OR coalesce(icure, FALSE) AS mcure
  FROM kb LEFT JOIN inherited i USING (doc_id, idx)),
asd AS MATERIALIZED (
  SELECT {_COLS}, rule, category, risk_level, unfairness, summary, pushback, risk_reasons
  FROM (SELECT *, {_DECIDE} AS rule FROM eff) JOIN outcome USING (rule))"""
)

FAIRNESS_OF = """
(SELECT doc_id, CAST(CASE WHEN sum(w) IS NULL THEN 50 ELSE
    greatest(10, least(100, round_even(sum(f * w) / sum(w) - pen, 0))) END AS BIGINT) AS fairness,
    hc AS high_count, mc AS medium_count, n_clauses
 FROM (SELECT doc_id, greatest(0, least(100, 100 - unfairness)) AS f,
    CASE WHEN NOT is_risk_bearing THEN 2 WHEN risk_level = 'HIGH' THEN 30 WHEN risk_level = 'MEDIUM' THEN 18
         WHEN risk_level = 'NEUTRAL' THEN 5 ELSE 10 END AS w,
    sum(CASE WHEN is_risk_bearing AND risk_level = 'HIGH' THEN 1 ELSE 0 END) OVER d AS hc,
    sum(CASE WHEN is_risk_bearing AND risk_level = 'MEDIUM' THEN 1 ELSE 0 END) OVER d AS mc,
    count(*) OVER d AS n_clauses,
    CASE WHEN hc = 0 THEN 0 WHEN hc = 1 THEN 8 WHEN hc = 2 THEN 16 ELSE 16 + (hc - 2) * 5 END AS pen
   FROM {src} WINDOW d AS (PARTITION BY doc_id))
 GROUP BY doc_id, hc, mc, n_clauses, pen)"""


def fairness_of(source: str) -> str:
    return FAIRNESS_OF.replace("{src}", source)


BEARING = "(is_risk_bearing AND clause_kind NOT IN ('DEFINITION', 'HEADING', 'RECITAL', 'BOILERPLATE'))"
SHOWN = BEARING + " AND risk_level <> 'NEUTRAL'"
MATERIAL = (
    f"{BEARING} AND risk_level NOT IN ('LOW', 'NEUTRAL') AND unfairness >= 35 AND NOT (risk_level = 'MEDIUM' AND "
    f"(({rx('lower(text)', lex.PROTECTIVE)} AND NOT {says('lower(text)', 'material_trap')}) "
    "OR (len(risk_reasons) = 0 AND unfairness < 45)))"
)
RANK_ORDER = f"{ordinal('risk_level')} DESC, unfairness DESC, len(risk_reasons) DESC, idx"

GLOBAL_QUESTION = (
    "({m} <> '' AND NOT " + rx("{m}", lex.SPECIFIC_CLAUSE_QUESTION).replace("{m}", "{m}") + " AND ("
    + " OR ".join(rx("{m}", p) for p in lex.GLOBAL_RISK_QUESTIONS) + "))"
)


def global_question(expr: str) -> str:
    return GLOBAL_QUESTION.replace("{m}", f"lower({pystrip(expr)})")


QUESTION_VALUES = "question(q_id, message) AS (VALUES " + ", ".join(
    f"({i}, {q(m)})" for i, m in enumerate(QUESTIONS)
) + ")"
