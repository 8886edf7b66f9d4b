"""Plans over tables that grow: nothing that is built from them is sent through the driver."""

import pytest

from pactscope.operators import retrieval
from pactscope.plans import catalogue
from pactscope.sources import corpus
from pactscope.streaming import audit

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "g8_attribute_page", "p5_validate_offsets", "p9_non_overlapping_spans", "w2_retrieve_top_k", "w4_chat_context",
    "r25_material_risk_report", "s13_consultation_brief", "x5_merge_verdicts",
])
def test_no_table_is_broadcast(spark, name):
    assert "BroadcastExchange" not in plan(catalogue.QUERIES[name](spark, SF))


def test_the_audit_broadcasts_nothing(spark):
    judged = audit.audit(corpus.paged_files(spark, SF))
    assert "BroadcastExchange" not in plan(judged)
    index = retrieval.clause_vectors(judged)
    assert "BroadcastExchange" not in plan(retrieval.retrieve_top_k(corpus.questions(spark, SF), index, 4))
