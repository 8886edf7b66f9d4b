"""The corpus reaches every rule outcome, pattern and relation."""

from pyspark.sql import functions as F

from pactscope.functions import lexicon as lex
from pactscope.functions.wording import OUTCOMES, RELATION_TEXTS
from pactscope.plans import rule_queries

SF = "/root/testdata/sf0.001"


def test_every_outcome(spark):
    judged = rule_queries.QUERIES["r19_evaluate_documents_all_templates"](spark, SF)
    assert {r.rule for r in judged.select("rule").distinct().collect()} == set(OUTCOMES)


def test_every_pattern(spark):
    flags = rule_queries.QUERIES["r1_pattern_flags_all_templates"](spark, SF)
    seen = flags.agg(*[F.max(n).alias(n) for n in lex.PATTERNS]).first()
    assert [n for n in lex.PATTERNS if not seen[n]] == []


def test_every_relation(spark):
    edges = rule_queries.QUERIES["x3_reference_relation"](spark, SF)
    assert {r.relation for r in edges.select("relation").distinct().collect()} == set(RELATION_TEXTS)


def test_negations_occur(spark):
    found = rule_queries.QUERIES["r8_negation_rule"](spark, SF)
    assert {r.rule for r in found.select("rule").distinct().collect()} == {"no_indemnity", "bilateral_exit", "bilateral_other", "mutual_disclaimer"}
