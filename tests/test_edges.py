"""Inputs that the corpus doesn't hold: wrapped lines, control characters, ids of other forms, gaps, contracts without clauses."""

import random
import re

from pyspark.sql import functions as F

from pactscope.functions.lexicon import GUARDS, PATTERNS
from pactscope.functions.text import has_pattern, matches
from pactscope.operators import brief, ranking, retrieval, score, segment

CLAUSES = "doc_id long, idx int, clause_id string, title string, text string, summary string"
QUESTIONS = "doc_id long, q_no int, message string, selected_clause_id string"


def test_guards_hold_no_white_space():
    assert not [g for words in GUARDS.values() for g in words if re.search(r"\s", g)]


def test_guards_change_nothing(spark):
    """Sentences around the fragments, with any white space between words."""
    r = random.Random(6)
    said = [
        "in no event shall contractor owe more than fees", "each party shall indemnify and hold harmless the other",
        "liability shall not exceed the fees paid", "either party may cancel upon notice", "shall not be liable in no event",
        "capped at the fees", "within thirty days notice to cure", "governed by and construed under the laws of",
        "renew for successive terms", "neither party shall", "as defined in section 2", "accordance with the provisions of",
    ]
    rows = [("".join(w + r.choice([" ", "\n", "\t", "  ", "\r\n"]) for w in s.split(" ")),) for s in said for _ in range(12)]
    df = spark.createDataFrame(rows, "t string")
    for name in GUARDS:
        pair = df.select(has_pattern(F.col("t"), name).alias("g"), matches(F.col("t"), PATTERNS[name]).alias("p"))
        assert pair.filter("g <> p").count() == 0, name


def test_control_characters_stay_in_sections(spark):
    body = "The Client shall pay \u0001 each invoice \u0002 within thirty days of its receipt in full."
    text = f"1. Alpha\n{body}\n2. Beta\n{body}\n"
    found = spark.createDataFrame([(text,)], "t string").select(segment.section_chunks(F.col("t")).alias("s")).first().s
    assert [s.title for s in found] == ["1. Alpha", "2. Beta"]
    assert all("\u0001" in s.text and "\u0002" in s.text for s in found)


def test_selected_clause_of_any_id_and_gaps(spark):
    rows = [(1, 10 * i, f"c{i}", "t", "word", "") for i in range(1, 12)]
    clauses = spark.createDataFrame(rows, CLAUSES)
    asked = spark.createDataFrame([(1, 1, "zzzz", "c9"), (1, 2, "zzzz", None), (1, 3, "zzzz", "nothing")], QUESTIONS)
    near = {(r.q_no, r.ord): r.idx for r in retrieval.clause_with_neighbours(asked, clauses).collect()}
    assert near == {(1, 1): 90, (1, 2): 80, (1, 3): 100}
    context = retrieval.keyword_context(asked, clauses).orderBy("q_no", "pos").collect()
    assert [r.idx for r in context if r.q_no == 1] == [90, 10, 20, 30, 40, 50, 60]
    assert [r.idx for r in context if r.q_no == 2] == [10, 20, 30, 40, 50, 60, 70]
    late = clauses.filter("idx > 50")
    assert retrieval.retrieve_top_k(asked, late, 4).filter("q_no = 2").count() == 4


def _assessed(spark, rows):
    columns = "doc_id long, idx int, clause_id string, title string, text string, summary string, category string, risk_level string, " \
              "unfairness int, is_risk_bearing boolean, risk_reasons array<string>, pushback string"
    rows = [(*r, "OPERATIVE") for r in rows]
    return spark.createDataFrame(rows, columns + ", clause_kind string")


def test_rollup_with_a_missing_category(spark):
    rows = [(1, 1, "a", "t", "x", "s", None, "HIGH", 90, True, ["r"], None), (1, 2, "b", "t", "x", "s", "TERM", "LOW", 10, True, ["r"], None),
            (2, 1, "c", "t", "x", "s", None, "HIGH", 80, True, ["r"], None)]
    got = {(r.category, r.risk_level): (r.clause_count, r.contract_count) for r in score.portfolio_rollup(_assessed(spark, rows)).collect()}
    assert got == {(None, "HIGH"): (2, 2), ("TERM", "LOW"): (1, 1), (None, "ALL"): (2, 2), ("TERM", "ALL"): (1, 1), ("ALL", "ALL"): (3, 2)}


def test_contract_without_clauses_has_a_memo(spark):
    documents = spark.createDataFrame([(1, "a.pdf"), (2, "b.pdf")], "doc_id long, filename string")
    rows = [(1, i, f"c{i}", "t", "x" * 60, "s", "TERMINATION", "HIGH", 90, True, ["r"], "A long enough counter text.") for i in range(1, 10)]
    memo = brief.consultation_brief(_assessed(spark, rows), documents).collect()
    assert {r.doc_id for r in memo} == {1, 2}
    assert any("No critical" in str(r) for r in memo if r.doc_id == 2)
    report = ranking.material_risk_report(_assessed(spark, rows), documents).collect()
    assert {(r.doc_id, r.n_material) for r in report} == {(1, 9), (2, 0)}
    assert len(report) == 8
