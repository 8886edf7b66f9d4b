"""Segmentation, spans, payloads, citations and the stream filter on small fixtures."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pactscope.functions import citations
from pactscope.operators import batching, prepare, retrieval, segment, spans
from pactscope.sources import files, verdicts
from pactscope.streaming.citation_filter import last_words, pass_on


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("v")).first()[0]


def test_sections_and_noise(spark):
    body = "The parties agree on the matters set out in this part."
    text = f"MASTER TERMS\nintro\n1. Scope\n{body}\nGENERAL TERMS\n{body}\n2. Tiny\nx\nPAGE LIABILITY\n{body}"
    got = one(spark, text, segment.section_chunks(F.col("text")))
    # a capitalised heading runs on over line ends into the next capital letter
    assert [s.title for s in got] == ["1. Scope", "GENERAL TERMS T"]
    assert got[0].text == f"1. Scope\n{body}"


def test_windows(spark):
    paragraphs = [" ".join(["w"] * n) for n in (200, 150, 1, 400, 10)]
    got = one(spark, "\n\n".join(paragraphs), segment.paragraph_windows(F.col("text")))
    assert [len(s.text.split()) for s in got] == [350, 1, 400, 10]
    assert [s.title for s in got][1] == "Section 2"


def test_subclause_titles(spark):
    text = (
        '1. TERM AND TERMINATION\n1.1 Termination rights: either side may leave.\n1.2 Notice. Notice is in writing.\n1.3 x\n'
        '2. Definitions\n2.1 "Work" means all tasks.\n2.2 The following words are used as described below in this part.\n'
        "3. Payment for the services rendered under this contract\n3.1 Late fees: these are due at once."
    )
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = [r.title for r in segment.number_clauses(docs).orderBy("idx").collect()]
    assert got == [
        "1.1 Termination rights",
        "1.2 TERM AND TERMINATION — Notice",
        "2.1 Definitions — \"Work\"",
        "2.2 Definitions — The following words are used",
        "3.1 Late fees",
    ]


def test_clean_and_decode(spark):
    assert one(spark, " a-\r\nb (cid:127)\rc \n", prepare.clean_text(F.col("text"))) == "ab •\nc"
    raw = spark.createDataFrame([(bytearray(b"ok\xff\xef\xbf\xbd end"),)], "b binary")
    assert raw.select(prepare.decode_text(F.col("b"))).first()[0] == "ok� end"


def test_read_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("  Zahl-\nung é \r\nzwei ".encode())
    row = files.read_contract_text(spark, str(tmp_path)).first()
    assert (row.filename, row.page_no, row.text) == ("a.txt", 1, "Zahlung é \nzwei")


def test_spans(spark):
    page = "Intro. The  Client\npays fees (net 30). The client pays fees (net 30)."
    df = spark.createDataFrame([(page, "the client pays fees (net 30)."), (page, "Intro. the client PAYS"), (page, "absent text, not here")],
                               "page string, clause string")
    got = df.select(spans.find_offsets(F.col("clause"), F.col("page")).alias("f"), spans.safe_unique_span(F.col("page"), F.col("clause")).alias("u")).collect()
    assert (got[0].f.start, got[0].u) == (7, None)
    assert page[got[1].f.start:got[1].f.end] == "Intro. The  Client\npays" and got[1].u == got[1].f
    assert got[2].f is None and got[2].u is None


def test_overlaps(spark):
    rows = [(1, 1, 1, 0, 50), (1, 1, 2, 40, 60), (1, 1, 3, 50, 55), (1, 2, 4, 0, 5)]
    df = spark.createDataFrame(rows, "doc_id long, page_no int, idx int, start int, end int")
    assert sorted(r.idx for r in spans.non_overlapping_spans(df).collect()) == [1, 3, 4]


def test_documents_of_any_size_are_assembled(spark):
    pages = spark.createDataFrame([(1, 1, "abc"), (1, 2, ""), (1, 3, "d"), (2, 1, "x" * 50)], "doc_id long, page_no int, text string")
    pages = pages.unionByName(pages.selectExpr("3L as doc_id", "1 as page_no", "repeat('y', 27000000) as text").limit(1))
    got = prepare.assemble_full_text(pages).selectExpr("doc_id", "left(text, 10)", "length(text)").collect()
    assert sorted(map(tuple, got)) == [(1, "abc\n\nd", 6), (2, "x" * 10, 50), (3, "y" * 10, 27_000_000)]


def test_batches(spark):
    rows = [(1, i, "t" * n, "") for i, n in enumerate((4000, 2000, 1, 9000, 5), 1)]
    df = spark.createDataFrame(rows, "doc_id long, idx int, title string, text string")
    assert [r.batch_no for r in batching.pack_batches(df).orderBy("idx").collect()] == [1, 1, 2, 3, 4]


def test_payloads(spark):
    good = '{"overall_fairness_score": 42, "clauses": [{"clause_id": "a", "unfairness_score": "7", "risk_reasons": "one"}]}'
    for text, want in [(good, "a"), (f"```json\n{good}\n```", "a"), (f"Sure: {good} bye", "a"), ("{broken", None), ("no json", None), ("[1]", None)]:
        got = one(spark, text, verdicts.parse_verdict_json(F.col("text")))
        assert (got.clauses[0].clause_id if got else None) == want, text


def test_small_contract_gives_all_in_order(spark):
    clauses = spark.createDataFrame([(1, i, "t", w, "") for i, w in enumerate(("a", "b b", "fee"), 1)], "doc_id long, idx int, title string, text string, summary string")
    asked = spark.createDataFrame([(1, 1, "fee", None)], "doc_id long, q_no int, message string, selected_clause_id string")
    assert [r.idx for r in retrieval.retrieve_top_k(asked, clauses, 3).orderBy("pos").collect()] == [1, 2, 3]
    assert [r.idx for r in retrieval.retrieve_top_k(asked, clauses, 2).orderBy("pos").collect()] == [3, 1]


def test_citations(spark):
    text = "Risk [CITE:a] and [CITE:b] , again [CITE:a]."
    assert one(spark, text, citations.valid_citations(F.col("text"), F.array(F.lit("a")))) == ["a"]
    assert one(spark, text, citations.strip_citations(F.col("text"))) == "Risk and, again."


def run_filter(chunks):
    held, shown = "", ""
    for chunk in chunks:
        out, held = pass_on(held, chunk)
        shown += out
    return shown + last_words(held)


def test_filter_example():
    assert run_filter(["Risk in [CI", "TE:clause_4] is", " high [note]", " end [CIT"]) == "Risk in  is high [note] end "


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "[CITE:x1]", "[note]", "b."]), max_size=12), st.lists(st.integers(1, 5), min_size=1, max_size=9))
def test_filter_is_independent_of_chunking(pieces, sizes):
    text, chunks, at, i = "".join(pieces), [], 0, 0
    while at < len(text):
        n = sizes[i % len(sizes)]
        chunks.append(text[at:at + n])
        at, i = at + n, i + 1
    assert run_filter(chunks) == re.sub(r"\[CITE:[a-zA-Z0-9_-]+\]", "", text)
