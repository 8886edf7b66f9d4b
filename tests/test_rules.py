"""Hand-traced clauses, scores and references."""

import re

from pyspark.sql import functions as F

from pactscope.functions import lexicon as lex
from pactscope.functions.text import has_pattern
from pactscope.operators import predicates, ranking, rules, score, xref
from pactscope.sources.corpus import TEMPLATES

# (kind, category, level, score) per template, for the clause alone
EXPECTED = [
    ("OPERATIVE", "INDEMNIFICATION", "HIGH", 92), ("OPERATIVE", "INDEMNIFICATION", "LOW", 30),
    ("OPERATIVE", "INDEMNIFICATION", "MEDIUM", 55), ("OPERATIVE", "INDEMNIFICATION", "LOW", 15),
    ("OPERATIVE", "INDEMNIFICATION", "HIGH", 92), ("OPERATIVE", "PAYMENT_TERMS", "LOW", 20),
    ("OPERATIVE", "INTELLECTUAL_PROPERTY", "HIGH", 88), ("OPERATIVE", "INTELLECTUAL_PROPERTY", "LOW", 25),
    ("OPERATIVE", "INTELLECTUAL_PROPERTY", "MEDIUM", 55), ("OPERATIVE", "OTHER", "LOW", 15),
    ("OPERATIVE", "PAYMENT_TERMS", "MEDIUM", 55), ("OPERATIVE", "TERMINATION", "MEDIUM", 55),
    ("OPERATIVE", "TERMINATION", "HIGH", 80), ("OPERATIVE", "TERMINATION", "HIGH", 85),
    ("OPERATIVE", "TERMINATION", "MEDIUM", 55), ("OPERATIVE", "TERMINATION", "HIGH", 85),
    ("OPERATIVE", "TERMINATION", "MEDIUM", 50), ("OPERATIVE", "PAYMENT_TERMS", "MEDIUM", 65),
    ("OPERATIVE", "PAYMENT_TERMS", "LOW", 20), ("OPERATIVE", "MISC", "HIGH", 90),
    ("OPERATIVE", "PAYMENT_TERMS", "MEDIUM", 60), ("OPERATIVE", "DISPUTE_RESOLUTION", "HIGH", 85),
    ("OPERATIVE", "DISPUTE_RESOLUTION", "LOW", 20), ("DEFINITION", "OTHER", "NEUTRAL", 10),
    ("BOILERPLATE", "OTHER", "NEUTRAL", 10), ("RECITAL", "OTHER", "NEUTRAL", 10),
]


def clause_table(spark, rows):
    """rows: (doc_id, idx, title, text)"""
    df = spark.createDataFrame(rows, "doc_id long, idx int, title string, text string")
    return df.withColumns(
        {
            "clause_id": F.concat(F.lit("clause_"), "idx"),
            "page_no": F.lit(1),
            "start_offset": F.lit(None).cast("int"),
            "end_offset": F.lit(None).cast("int"),
        }
    )


def verdict(row):
    return row.clause_kind, row.category, row.risk_level, row.unfairness


def test_templates(spark):
    rows = [(0, i, t, b.replace("{ref}", "3")) for i, (t, b) in enumerate(TEMPLATES)]
    got = {r.idx: verdict(r) for r in rules.evaluate_clauses(clause_table(spark, rows)).collect()}
    assert got == dict(enumerate(EXPECTED))


def test_single_clauses(spark):
    rows = [
        (0, 1, "5. GENERAL", "5. GENERAL"),
        (0, 2, "NOTICES", "Notices shall be in writing and sent by courier."),
        (0, 3, "LIMITS", "Contractor shall not be liable and neither party shall bear indirect damages."),
        (0, 4, "CARVE-OUT", "Contractor shall not indemnify Client for anything."),
        (0, 5, "DAMAGES", "Each party has no liability for indirect damages of any sort."),
        (0, 6, "1. DEFINITIONS", '"Loss" means any and all losses of Client.'),
    ]
    got = {r.idx: verdict(r) for r in rules.evaluate_clauses(clause_table(spark, rows)).collect()}
    assert got == {
        1: ("HEADING", "OTHER", "NEUTRAL", 10),
        2: ("BOILERPLATE", "OTHER", "NEUTRAL", 10),
        3: ("OPERATIVE", "OTHER", "LOW", 20),
        4: ("OPERATIVE", "INDEMNIFICATION", "LOW", 15),
        5: ("OPERATIVE", "LIABILITY", "LOW", 20),
        6: ("OPERATIVE", "OTHER", "LOW", 20),
    }


def test_non_ascii_space_counts_as_space(spark):
    rows = [(0, 1, "X", "Contractor shall not pay and shall indemnify Client for all losses.")]
    assert rules.evaluate_clauses(clause_table(spark, rows)).first().rule == "indemnity_negated"


def test_references_soften(spark):
    cite = "Contractor shall indemnify Client for any and all claims, subject to Section 2."
    rows = [
        (1, 1, "1. INDEMNITY", cite), (1, 2, "2. CAP", "Liability is limited to fees received."),
        (2, 1, "1. INDEMNITY", cite), (2, 2, "2. CURE", "There is a cure period of ten days."),
        (3, 1, "1. INDEMNITY", cite), (3, 2, "2. OTHER", "Client shall pay the invoice."),
        (4, 1, "1. INDEMNITY", cite.replace("subject to", "notwithstanding")), (4, 2, "2. CAP", "Liability is limited to fees."),
    ]
    clauses = clause_table(spark, rows)
    got = {r.doc_id: (r.risk_level, r.unfairness) for r in xref.evaluate_documents(clauses).where("idx = 1").collect()}
    assert got == {1: ("MEDIUM", 55), 2: ("MEDIUM", 60), 3: ("HIGH", 92), 4: ("HIGH", 92)}
    edges = {(r.doc_id, r.relation) for r in xref.resolve_references(clauses).collect()}
    assert edges == {(1, "mitigates"), (2, "mitigates"), (3, "limits"), (4, "overrides")}


def test_labels(spark):
    rows = [(1, 1, "Civil matters", "x"), (1, 2, "Section 4.2 Scope", "x"), (1, 3, "Scope", "Article 7 applies"), (1, 4, "4.2", "dup")]
    got = {r.label: r.dst_idx for r in xref.build_label_index(clause_table(spark, rows)).collect()}
    assert got == {"civil": 1, "4.2": 2, "7": 3}


def test_fairness_by_hand(spark):
    rows = [(7, i, TEMPLATES[t][0], TEMPLATES[t][1]) for i, t in enumerate([0, 18, 23])]
    docs = spark.createDataFrame([(7,), (8,)], "doc_id long")
    got = {r.doc_id: r.fairness for r in score.overall_fairness(rules.evaluate_clauses(clause_table(spark, rows)), docs).collect()}
    assert got == {7: 21, 8: 50}


def test_hot_contract_keeps_every_row(spark):
    """One contract holds most clauses, all citing the same label."""
    rows = [(1, i, f"{i}. INDEMNITY", TEMPLATES[4][1].replace("{ref}", "1")) for i in range(2, 3000)]
    rows += [(1, 1, "1. CAP", "Liability is limited to fees received.")] + [(d, 1, "1. TERM", TEMPLATES[9][1]) for d in range(2, 300)]
    out = xref.evaluate_documents(clause_table(spark, rows))
    assert out.count() == len(rows)
    hot = out.where("doc_id = 1 AND idx > 1")
    assert {(r.risk_level, r.unfairness) for r in hot.select("risk_level", "unfairness").distinct().collect()} == {("MEDIUM", 55)}
    assert ranking.rank_risk_clauses(out).where("doc_id = 1").count() == 7


def test_filters_stay_above_the_decision(spark):
    rows = [(0, i, t, b) for i, (t, b) in enumerate(TEMPLATES)]
    out = rules.evaluate_clauses(clause_table(spark, rows)).where("risk_level = 'HIGH'")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 120


def test_global_questions(spark):
    rows = [("What are the biggest risks?", True), ("What does clause 3 say about the highest risk?", False), ("  ", False),
            ("Where am I most exposed?", True), ("Who owns the code?", False)]
    df = spark.createDataFrame(rows, "m string, want boolean")
    assert df.where(predicates.is_global_risk_question(F.col("m")) != F.col("want")).count() == 0


def test_the_assessment_is_no_single_method(spark):
    """In whole-stage code all tests of a clause's words are one method, larger than the JVM compiles."""
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.enabled", "false")
    rows = session.createDataFrame([(0, 1, t, b) for t, b in TEMPLATES], "doc_id long, idx int, title string, text string")
    clauses = rows.withColumns({"clause_id": F.lit("clause_1"), "page_no": F.lit(1), "start_offset": F.lit(0), "end_offset": F.lit(0)})
    for out in (rules.evaluate_clauses(clauses), xref.evaluate_documents(clauses)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        fused = [line for line in plan.splitlines() if re.search(r"\*\(\d+\)", line) and line.count("Contains(") + line.count("RLIKE") > 4]
        assert "RLIKE" in plan and not fused


def phrases_of(pattern):
    """Every phrase of an alternation once as a text: options taken, first of each group, blanks single."""
    inner = pattern.removeprefix(r"\b(?:").removesuffix(r")\b")
    tree = re._parser.parse(inner)
    branches = tree[0][1][1] if len(tree) == 1 and str(tree[0][0]) == "BRANCH" else [tree]

    def texts(items):
        found = [""]
        for op, value in items:
            kind = str(op)
            if kind == "LITERAL":
                more = [chr(value)]
            elif kind == "IN":
                more = [" " if any("SPACE" in str(v) for _, v in value) else "7" if any("DIGIT" in str(v) for _, v in value) else chr(value[0][1] if isinstance(value[0][1], int) else value[0][1][0])]
            elif kind == "ANY":
                more = ["x"]
            elif kind == "SUBPATTERN":
                more = texts(value[-1])
            elif kind == "BRANCH":
                more = [t for b in value[1] for t in texts(b)]
            elif kind == "MAX_REPEAT":
                low, _, inside = value
                more = [t * max(low, 1) for t in texts(inside)] + ([""] if low == 0 else [])
            else:
                raise ValueError(kind)
            found = [a + b for a in found for b in more]
        return found

    return [t for b in branches for t in texts(b)]


def test_shortcuts_lose_no_phrase(spark):
    """Guards and looks at the next letter hold for every phrase of every pattern."""
    cases = [(name, t) for name, p in lex.PATTERNS.items() if p in lex.INITIALS for t in set(phrases_of(p))]
    assert len(cases) > 300
    for name, text in cases:
        assert re.search(f"(?={lex.INITIALS[lex.PATTERNS[name]]})" + lex.PATTERNS[name], text), (name, text)
        assert name not in lex.GUARDS or any(g in text for g in lex.GUARDS[name]), (name, text)
    seen = spark.createDataFrame([(n, f"so {t}.") for n, t in cases if not t.startswith("^")], "name string, _body string")
    for name in lex.GUARDS:
        assert seen.where((F.col("name") == name) & ~has_pattern("_body", name)).count() == 0
