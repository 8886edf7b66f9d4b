"""Registered queries over chat data, memos and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactscope.functions import citations
from pactscope.functions import lexicon as lex
from pactscope.functions.wording import COUNSEL_QUESTIONS
from pactscope.operators import brief, chat, ranking, retrieval, score
from pactscope.plans import oracle_core as oc
from pactscope.plans.retrieval_queries import ASKED, SCORES, _top
from pactscope.plans.rule_queries import _FAMILY_OF, assessed
from pactscope.sources import corpus
from pactscope.streaming import assembly, audit, citation_filter, runs

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
BIG = lambda *names: [F.col(n).cast("bigint").alias(n) for n in names]


def query(name, sql=None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = "WITH " + sql.strip()
        return fn

    return register


# -- W10 --------------------------------------------------------------------
def _turns_sql(low: int, high: int) -> str:
    return f"""r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations)
      SELECT conv_id, turn, CASE WHEN role IN ('assistant', 'model') THEN 'assistant' ELSE 'user' END AS role,
        md5({oc.pystrip('text')}) AS digest FROM r WHERE back BETWEEN {low} AND {high} AND {oc.pystrip('text')} <> ''"""


@query("w10_last_turns", _turns_sql(1, 6))
def w10(spark, sf_dir):
    out = chat.last_turns(corpus.table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


@query("w10_last_turns_before_newest", _turns_sql(2, 7))
def w10_client(spark, sf_dir):
    out = chat.last_turns(corpus.table(spark, sf_dir, "conversations"), skip_newest=True)
    return out.select("conv_id", "turn", "role", F.md5("text").alias("digest"))


# -- citations: X10, U2, U3, X11 --------------------------------------------
_ANSWERS = oc.CONTRACTS.strip() + """,
ans AS MATERIALIZED (
  SELECT doc_id, n, 'clause_' || (1 + doc_id % n) AS a, 'clause_' || (1 + (doc_id + 1) % n) AS b,
    CASE doc_id % 3 WHEN 0 THEN ' end [CIT' WHEN 1 THEN ' end [CITE:clause_' ELSE ' end [' END AS tail FROM contracts),
raw AS MATERIALIZED (SELECT *, 'Risk in [CITE:' || a || '] is high , see [CITE:' || b || '] and [CITE:clause_99] or [CITE:' || a
  || ']. Keep [note] here' || tail AS raw FROM ans)"""


@query(
    "x10_valid_citations",
    _ANSWERS + """ SELECT doc_id, a || ',' || b AS cited,
      'Risk in is high, see and or. Keep [note] here' || rtrim(tail) AS cleaned FROM raw""",
)
def x10(spark, sf_dir):
    rows = corpus.answers(spark, sf_dir)
    return rows.select(
        "doc_id", F.array_join(citations.valid_citations(F.col("raw"), F.col("allowed")), ",").alias("cited"),
        citations.strip_citations(F.col("raw")).alias("cleaned"))


@query("u3_keep_allowed", _ANSWERS + " SELECT doc_id, 'clause_' || (1 + doc_id % n) || ',' || b AS kept FROM raw")
def u3(spark, sf_dir):
    rows = corpus.answers(spark, sf_dir)
    kept = F.array_intersect(citations.cited_ids(F.col("raw")), F.col("allowed"))
    return rows.select("doc_id", F.array_join(kept, ",").alias("kept"))


@query("u2_citation_union", _ANSWERS + " SELECT doc_id AS msg_id, b || ',' || a || ',clause_99' AS cited FROM raw")
def u2(spark, sf_dir):
    """Two citation events per message, the second one repeating part of the first."""
    ids = citations.cited_ids(F.col("raw"))
    events = F.array(
        F.struct(F.lit(1).alias("seq"), F.slice(ids, 2, 1).alias("clause_ids")), F.struct(F.lit(2).alias("seq"), ids.alias("clause_ids"))
    )
    rows = corpus.answers(spark, sf_dir).select(F.col("doc_id").alias("msg_id"), F.inline(events))
    return chat.message_citations(rows).select("msg_id", F.array_join("clause_ids", ",").alias("cited"))


@query(
    "x11_clause_label_lookup",
    oc.CLAUSES + """ SELECT c.doc_id, v.clause_id, coalesce(cl.title, 'CLAUSE 99') AS label
      FROM (SELECT doc_id, unnest(['clause_' || (1 + doc_id % n), 'clause_' || (1 + (doc_id + 1) % n), 'clause_99']) AS clause_id FROM contracts) v
      JOIN contracts c ON c.doc_id = v.doc_id LEFT JOIN cl ON cl.doc_id = v.doc_id AND cl.clause_id = v.clause_id""",
)
def x11(spark, sf_dir):
    cited = F.explode(F.array_distinct(citations.cited_ids(F.col("raw")))).alias("clause_id")
    rows = corpus.answers(spark, sf_dir).select("doc_id", cited)
    return chat.clause_labels(rows, corpus.clauses(spark, sf_dir)).select("doc_id", "clause_id", "label")


# -- A9, K4, S15 ------------------------------------------------------------
def _messages(df):
    return df.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), "text")


@query("a9_message_text", """x AS (SELECT 1) SELECT conv_id * 1000 + turn AS msg_id, md5(text) AS digest,
  len(string_split(text, ' ')) AS n_chunks FROM conversations""")
def a9(spark, sf_dir):
    chunks = corpus.message_chunks(_messages(corpus.table(spark, sf_dir, "conversations")))
    return chat.message_text(chunks).select("msg_id", F.md5("text").alias("digest"), *BIG("n_chunks"))


_EVENTS = oc.ASSESSED + """,
sug AS (SELECT doc_id, pushback FROM asd WHERE risk_level = 'HIGH' AND pushback <> ''
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY idx) = 1),
line AS (SELECT doc_id, 'See [CITE:clause_1] and clause ' || n || '.' AS said FROM contracts),
ev AS MATERIALIZED (
  SELECT doc_id AS msg_id, 1 AS stage, g - 1 AS seq, 'token' AS type, w[g] || CASE WHEN g < len(w) THEN ' ' ELSE '' END AS content
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS g FROM (SELECT doc_id, string_split(said, ' ') AS w FROM line))
  UNION ALL SELECT doc_id, 2, 0, 'suggestion', pushback FROM sug
  UNION ALL SELECT doc_id, 3, 0, 'citation', 'clause_1' FROM contracts
  UNION ALL SELECT doc_id, 4, 0, 'done', '' FROM contracts)"""


def events(spark, sf_dir):
    contract = corpus.contracts(spark, sf_dir)
    said = F.concat(F.lit("See [CITE:clause_1] and clause "), F.col("n_clauses"), F.lit("."))
    line = contract.select(F.col("doc_id").alias("msg_id"), said.alias("text"))
    suggestion = ranking.applicable_suggestion(assessed(spark, sf_dir), ["doc_id"], "idx").withColumnRenamed("doc_id", "msg_id")
    cited = line.select("msg_id", citations.cited_ids(F.col("text")).alias("clause_ids"))
    return chat.event_rows(corpus.message_chunks(line), suggestion, cited)


@query("k4_event_sequence", _EVENTS + " SELECT * FROM ev")
def k4(spark, sf_dir):
    return events(spark, sf_dir).select("msg_id", *BIG("stage", "seq"), "type", "content")


@query(
    "s15_typed_chat_events",
    _EVENTS + """ SELECT msg_id, stage, seq, CASE WHEN type = 'token' AND msg_id % 10 = 7 THEN 'malformed' ELSE 'ok' END AS status,
      CASE WHEN type = 'token' AND msg_id % 10 = 7 THEN '' ELSE type END AS type,
      CASE WHEN type = 'token' AND msg_id % 10 <> 7 THEN replace(content, '[CITE:clause_1]', '') ELSE '' END AS content,
      CASE WHEN type = 'citation' THEN content ELSE '' END AS cited,
      CASE WHEN type = 'suggestion' THEN content ELSE '' END AS counter_clause FROM ev""",
)
def s15(spark, sf_dir):
    """Events written as JSON and read back; every tenth message's tokens are cut off on the way."""
    t = F.col("type")
    body = F.struct(
        t.alias("type"),
        F.when(t == "token", F.col("content")).alias("content"),
        F.when(t == "citation", F.split("content", ",")).alias("clause_ids"),
        F.when(t == "suggestion", F.col("content")).alias("counter_clause"),
    )
    whole = F.to_json(body)
    cut = F.when((t == "token") & (F.col("msg_id") % 10 == 7), F.substring(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole)
    log = events(spark, sf_dir).select("msg_id", "stage", "seq", F.when(t == "done", "[DONE]").otherwise(cut).alias("payload"))
    out = chat.typed_chat_events(log)
    return out.select(
        "msg_id", *BIG("stage", "seq"), "status", *[F.coalesce(c, F.lit("")).alias(c) for c in ("type", "content")],
        F.coalesce(F.array_join("clause_ids", ","), F.lit("")).alias("cited"), F.coalesce("counter_clause", F.lit("")).alias("counter_clause"))


# -- P11, S13, S14 ----------------------------------------------------------
_BLOCK = """'[' || clause_id || ']' || chr(10) || 'Title: ' || title || chr(10) || 'Kind: ' || clause_kind || chr(10) || 'Risk Bearing: '
  || CASE WHEN is_risk_bearing THEN 'true' ELSE 'false' END || chr(10) || 'Risk Level: ' || risk_level || chr(10) || 'Unfairness Score: '
  || unfairness || chr(10) || 'Risk Reasons:' || chr(10) || CASE WHEN len(risk_reasons) = 0 THEN '- None'
     ELSE '- ' || array_to_string(risk_reasons, chr(10) || '- ') END || chr(10) || 'Category: ' || category || chr(10)
  || 'Text:' || chr(10) || text || chr(10) || 'Summary:' || chr(10) || summary
  || coalesce(chr(10) || 'Suggested Pushback: ' || pushback, '')"""


@query("p11_format_clause_context", oc.ASSESSED + f" SELECT doc_id, idx, {_BLOCK} AS block FROM asd")
def p11(spark, sf_dir):
    return assessed(spark, sf_dir).select("doc_id", *BIG("idx"), chat.clause_context().alias("block"))


@query(
    "p11_format_context",
    oc.ASSESSED + f""", top AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {oc.RANK_ORDER}) AS rn FROM asd
        WHERE {oc.MATERIAL} QUALIFY rn <= 7),
      b AS (SELECT doc_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY rn) AS t FROM top GROUP BY doc_id)
      SELECT c.doc_id, 'ACTIVE CONTRACT CONTEXT:' || chr(10) || '- Document Filename: ' || filename || chr(10)
        || '- Overall Fairness Score: ' || fairness || '/100' || chr(10) || chr(10) || 'RELEVANT CLAUSES IN CONTEXT:' || chr(10)
        || coalesce(t, 'General contract terms.') AS context
      FROM contracts c JOIN {oc.fairness_of('asd')} f ON f.doc_id = c.doc_id LEFT JOIN b ON b.doc_id = c.doc_id""",
)
def p11_whole(spark, sf_dir):
    judged, contract = assessed(spark, sf_dir), corpus.contracts(spark, sf_dir)
    return chat.contract_context(ranking.rank_risk_clauses(judged), contract, score.overall_fairness(judged, contract))


def _brief_sql(by_family: bool) -> str:
    families = ["lease", "nda", "services"] if by_family else ["brief"]
    rows = ", ".join(f"('{f}', {i}, {oc.q(t)})" for f in families for i, t in enumerate(COUNSEL_QUESTIONS[f], 1))
    family = _FAMILY_OF if by_family else "'brief'"
    limit = (lambda n: "") if by_family else (lambda n: f" WHERE k <= {n}")
    order = "idx" if by_family else "k"
    bearing = " AND is_risk_bearing" if by_family else ""
    return oc.ASSESSED + f""", q(family, ord, t) AS (VALUES {rows}),
      h AS (SELECT f.doc_id, filename, fairness, hc, mc FROM {oc.fairness_of('asd')} f JOIN contracts c ON c.doc_id = f.doc_id
        JOIN (SELECT doc_id, count(*) FILTER (risk_level = 'HIGH'{bearing}) AS hc, count(*) FILTER (risk_level = 'MEDIUM'{bearing}) AS mc
              FROM asd GROUP BY doc_id) n ON n.doc_id = f.doc_id),
      hi AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM asd WHERE risk_level = 'HIGH'{bearing}),
      pb AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM asd WHERE pushback <> '')
      SELECT doc_id, '1 header' AS section, 1::BIGINT AS ord, 'Contract: ' || filename AS line FROM h
      UNION ALL SELECT doc_id, '1 header', 2, 'Fairness Score: ' || fairness || '/100' FROM h
      UNION ALL SELECT doc_id, '1 header', 3, 'Identified Imbalances: ' || hc || ' High, ' || mc || ' Medium' FROM h
      UNION ALL SELECT doc_id, '2 summary', {order}, title || ': ' || summary FROM hi{limit(3)}
      UNION ALL SELECT doc_id, '2 summary', 0, 'No critical high-risk traps identified.' FROM h WHERE hc = 0
      UNION ALL SELECT doc_id, '3 questions', ord, t FROM (SELECT doc_id, {family} AS family FROM contracts) JOIN q USING (family)
      UNION ALL SELECT doc_id, '4 counter-language', {order}, title || ' (' || risk_level || '): ' || pushback FROM pb{limit(2)}
      UNION ALL SELECT doc_id, '5 audit', 1, 'Audit hash: ' || md5(doc_id || '|' || filename || '|' || fairness) FROM h
      UNION ALL SELECT doc_id, '6 notes', 1, 'Order status ' || status FROM contracts"""


def _brief(spark, sf_dir, by_family):
    judged, contract = assessed(spark, sf_dir), corpus.contracts(spark, sf_dir)
    notes = contract.select("doc_id", F.concat(F.lit("Order status "), "status").alias("notes"))
    return brief.consultation_brief(judged, contract, notes, by_family)


@query("s13_consultation_brief", _brief_sql(False))
def s13(spark, sf_dir):
    return _brief(spark, sf_dir, False)


@query("s14_consultation_brief_by_family", _brief_sql(True))
def s14(spark, sf_dir):
    return _brief(spark, sf_dir, True)


# -- streams: K1, K3, K5 ----------------------------------------------------
def _contract_stream(spark, sf_dir):
    return corpus.contracts_of(runs.table_stream(spark, sf_dir, "orders"))


@query(
    "k1_filter_citation_markers",
    _ANSWERS + """ SELECT doc_id AS msg_id, 'Risk in  is high , see  and  or . Keep [note] here end '
      || CASE WHEN doc_id % 3 = 2 THEN '[' ELSE '' END AS shown FROM raw""",
)
def k1(spark, sf_dir):
    """Answers cut into chunks that split their markers, filtered as a stream, then joined again."""
    said = corpus.answers_of(_contract_stream(spark, sf_dir)).select(F.col("doc_id").alias("msg_id"), F.col("raw").alias("text"))
    pieces = F.regexp_extract_all("text", F.lit(r"(?s).{1,7}"), F.lit(0))
    chunks = said.select("msg_id", F.size(pieces).alias("n"), F.posexplode_outer(pieces).alias("seq", "chunk")).select(
        "msg_id", "seq", "chunk", (F.col("seq") == F.col("n") - 1).alias("last"))
    shown = citation_filter.run_to_table(spark, chunks)
    return chat.message_text(shown.withColumnRenamed("content", "chunk")).select("msg_id", F.col("text").alias("shown"))


@query("k1_visible_text", ORACLE["k1_filter_citation_markers"].removeprefix("WITH ").replace("AS msg_id", "AS doc_id"))
def k1_batch(spark, sf_dir):
    """The same over whole messages, without state."""
    return corpus.answers(spark, sf_dir).select("doc_id", citations.visible_text(F.col("raw")).alias("shown"))


_CITED = "'clause_1,clause_' || (2 + turn) || ',clause_' || (3 + turn + conv_id % 2)"


def message_events(messages):
    """Events of messages (conv_id, turn, text): a token per word, two citation events that overlap, "done"."""
    words = F.split("text", " ")
    n, third = F.size(words), F.col("turn") + 3 + F.col("conv_id") % 2

    def event(seq, kind, content, ids):
        return F.struct(seq.cast("int").alias("seq"), F.lit(kind).alias("type"), content.cast("string").alias("content"),
                        ids.cast("array<string>").alias("clause_ids"))

    nothing, second = F.lit(None), F.concat(F.lit("clause_"), F.col("turn") + 2)
    tokens = F.transform(words, lambda w, i: event(i, "token", F.when(i < n - 1, F.concat(w, F.lit(" "))).otherwise(w), nothing))
    rest = F.array(
        event(n, "citation", nothing, F.array(F.lit("clause_1"), second)),
        event(n + 1, "citation", nothing, F.array(second, F.concat(F.lit("clause_"), third))),
        event(n + 2, "done", nothing, nothing),
    )
    return messages.select((F.col("conv_id") * 1000 + F.col("turn")).alias("msg_id"), F.inline(F.concat(tokens, rest)))


_ASSEMBLED = f"""x AS (SELECT 1) SELECT conv_id * 1000 + turn AS msg_id, 'done' AS status, md5(text) AS digest,
  len(string_split(text, ' ')) AS n_chunks, {_CITED} AS cited FROM conversations"""


def _assembled(messages):
    return messages.select("msg_id", "status", F.md5("text").alias("digest"), *BIG("n_chunks"), F.array_join("clause_ids", ",").alias("cited"))


@query("k3_message_assembly", _ASSEMBLED)
def k3(spark, sf_dir):
    events = message_events(runs.table_stream(spark, sf_dir, "conversations"))
    return _assembled(assembly.run_to_table(spark, events))


@query("k3_message_assembly_batch", _ASSEMBLED)
def k3_batch(spark, sf_dir):
    """The same over a table, without state."""
    return _assembled(assembly.assemble_batch(message_events(corpus.table(spark, sf_dir, "conversations"))))


_AUDITED = oc.ASSESSED.replace(
    oc.CLAUSES,
    oc.CLAUSES.replace("cl AS MATERIALIZED (", "cl0 AS (") + """,
cl AS MATERIALIZED (SELECT doc_id, idx, clause_id, title, title || chr(10) || text AS text, page_no FROM cl0)""",
)


def _audited(spark, sf_dir):
    return audit.run_to_tables(spark, corpus.paged_files_of(_contract_stream(spark, sf_dir)))


@query("k5_audit_stream", _AUDITED + f" SELECT * FROM {oc.fairness_of('asd')}")
def k5(spark, sf_dir):
    return audit.committed(spark, _audited(spark, sf_dir), "scores")


@query("k5_indexed_retrieval", _AUDITED + "," + ASKED + SCORES + _top(4) + " SELECT * FROM top")
def k5_retrieval(spark, sf_dir):
    """Questions answered from the vectors that the stream wrote."""
    index = audit.committed(spark, _audited(spark, sf_dir), "index")
    return retrieval.retrieve_top_k(corpus.questions(spark, sf_dir), index, 4).select("doc_id", *BIG("q_no", "idx", "pos"))


@query(
    "k5_located_clauses",
    _AUDITED + """,
      sheets AS (SELECT doc_id, page_no, string_agg(text, chr(10) || chr(10) ORDER BY idx) AS page FROM cl GROUP BY doc_id, page_no)
      SELECT a.doc_id, a.idx, a.title, CAST(a.page_no AS BIGINT) AS page_no, instr(page, a.text) - 1 AS start_offset,
        instr(page, a.text) - 1 + length(a.text) AS end_offset, rule, risk_level, CAST(unfairness AS BIGINT) AS unfairness
      FROM asd a JOIN sheets s ON s.doc_id = a.doc_id AND s.page_no = a.page_no""",
)
def k5_located(spark, sf_dir):
    """From the uploaded file to judged clauses with page and offsets, in one plan."""
    out = audit.audit(corpus.paged_files(spark, sf_dir))
    return out.select("doc_id", *BIG("idx"), "title", *BIG("page_no", "start_offset", "end_offset"), "rule", "risk_level", *BIG("unfairness"))
