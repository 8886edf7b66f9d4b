"""Registered queries against their SQL on the smallest tables (the full list: tools/check.py)."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from pactscope.plans import catalogue
from tools.check import rows_of

SF = "/root/testdata/sf0.001"
QUICK = [
    "a1_least_fair_contracts", "r2_classify_kind", "r19_evaluate_documents", "x2_resolve_references", "w1_rank_risk_clauses",
    "w2_retrieve_top_k", "w5_keyword_context", "g3_segment_or_window", "g5_subclause_title", "g8_attribute_page",
    "p7_resolve_highlight_span", "s3_assemble_full_text", "x5_merge_verdicts", "s7_hydrate_clauses", "s13_consultation_brief",
    "k1_filter_citation_markers", "k3_message_assembly", "k5_audit_stream",
]


def test_every_query_of_the_library_has_sql():
    assert set(catalogue.ORACLE) == set(catalogue.QUERIES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", QUICK)
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(entry_point.oracle_sql()[name])
    want, columns = cur.fetchall(), [c[0] for c in cur.description]
    df = entry_point.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert rows_of(df.columns, df.collect()) == rows_of(columns, want)
    assert want
