"""Registered queries over whole texts: preparation, segmentation, pages and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactscope.functions import lexicon as lex
from pactscope.functions.text import flag, normalize_ws, strip
from pactscope.operators import batching, prepare, segment, spans
from pactscope.plans import oracle_core as oc
from pactscope.plans.rule_queries import assessed
from pactscope.sources import corpus, files
from pactscope.streaming import runs

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


SP = lex.SPACE
NL = "chr(10)"


def squeeze(expr: str) -> str:
    return f"regexp_replace({expr}, {oc.q(SP)}, ' ', 'g')"


def clean(expr: str) -> str:
    lines = f"replace(replace(replace({expr}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(cid:127)', '•')"
    letter = r"[\p{L}\p{N}_]"
    return oc.pystrip(f"regexp_replace({lines}, '({letter}+)-\n({letter}+)', '\\1\\2', 'g')")


def quoted(expr: str) -> str:
    return f"regexp_escape({expr})"


# -- P1, P3, P12 over the prose table ---------------------------------------
@query("p1_clean_text", f"x AS (SELECT 1) SELECT doc_id, md5({clean('text')}) AS digest, length({clean('text')}) AS n FROM documents")
def p1(spark, sf_dir):
    cleaned = corpus.table(spark, sf_dir, "documents").select("doc_id", prepare.clean_text(F.col("text")).alias("t"))
    return cleaned.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))


@query(
    "s1_read_contract_text",
    f"""x AS (SELECT 1) SELECT doc_id, CASE WHEN doc_id % 50 = 7 THEN 'INVALID_FILE_TYPE' WHEN {clean('text')} = '' THEN 'PARSING_FAILED'
      ELSE 'ACCEPTED' END AS outcome, 1::BIGINT AS page_no, CASE WHEN doc_id % 50 <> 7 THEN md5({clean('text')}) END AS digest FROM documents""",
)
def s1(spark, sf_dir):
    """The text table written as one file per document and read back; every fiftieth one is of a kind that isn't read."""
    table = corpus.table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = runs.shared_folder(spark, "files")
    files.write_text_files(table.where("doc_id % 50 <> 7"), f"{folder}/texts")
    table.where("doc_id % 50 = 7").repartition("doc_id").write.partitionBy("doc_id").json(f"{folder}/others")
    read = files.contract_files(spark, folder)
    doc = F.regexp_extract("path", "doc_id=([0-9]+)", 1).cast("bigint")
    return read.where(F.contains("path", F.lit("doc_id="))).select(
        doc.alias("doc_id"), F.coalesce("error_code", F.lit("ACCEPTED")).alias("outcome"), *BIG("page_no"), F.md5("text").alias("digest"))


@query("p3_normalize_ws", f"x AS (SELECT 1) SELECT doc_id, length({squeeze('text')}) AS n, md5(lower({squeeze('text')})) AS digest FROM documents")
def p3(spark, sf_dir):
    from pactscope.functions.text import normalize_ws

    out = corpus.table(spark, sf_dir, "documents").select("doc_id", normalize_ws(F.col("text")).alias("t"))
    return out.select("doc_id", F.length("t").cast("bigint").alias("n"), F.md5("t").alias("digest"))


@query(
    "p12_word_chunks",
    f"""w AS (SELECT doc_id, regexp_extract_all(text, {oc.q(lex.WORD)}) AS w FROM documents),
      c AS (SELECT doc_id, w, unnest(generate_series(1, len(w), 350)) AS p0 FROM w WHERE len(w) > 0)
      SELECT doc_id, (p0 - 1) // 350 + 1 AS chunk_no, 'Section ' || ((p0 - 1) // 350 + 1) AS title,
        md5(array_to_string(w[p0:p0 + 349], ' ')) AS digest FROM c""",
)
def p12(spark, sf_dir):
    out = prepare.word_chunks(corpus.table(spark, sf_dir, "documents"))
    return out.select("doc_id", *BIG("chunk_no"), "title", F.md5("text").alias("digest"))


# -- corpus documents -------------------------------------------------------
DOCS = oc.CLAUSES + """,
docs AS MATERIALIZED (
  SELECT doc_id, 'SERVICES AGREEMENT ' || doc_id || chr(10) || chr(10)
    || string_agg(title || chr(10) || text, chr(10) || chr(10) ORDER BY idx) AS text FROM cl GROUP BY doc_id)"""

DIVIDED = oc.CLAUSES + """,
parts AS (
  SELECT doc_id, idx, title, title || chr(10) || CASE (doc_id + idx) % 5
    WHEN 0 THEN idx || '.1 Scope: ' || text || chr(10) || idx || '.2 The ' || lower(title) || ' rule is final and binding on all.'
    WHEN 1 THEN idx || '.1 "Fees" means all sums due.' || chr(10) || idx || '.2 ' || text
    WHEN 2 THEN 'Preamble.' || chr(10) || idx || '.1 Order of Steps — Carve-Out' || chr(10) || idx || '.2 short' || chr(10)
      || idx || '.3 ' || text
    ELSE text END AS body FROM cl),
docs AS MATERIALIZED (
  SELECT doc_id, 'SERVICES AGREEMENT ' || doc_id || chr(10) || chr(10)
    || string_agg(body, chr(10) || chr(10) ORDER BY idx) AS text FROM parts GROUP BY doc_id)"""

_RECITAL, _NUMBER = "(?mi)" + lex.RECITALS_LINE, "(?mi)" + lex.NUMBERED_LINE


def _at(pattern: str) -> str:
    return f"CASE WHEN regexp_matches(text, {oc.q(pattern)}) THEN instr(text, regexp_extract(text, {oc.q(pattern)})) END"


TITLED = f""",
titled AS MATERIALIZED (
  SELECT doc_id, text, cut_at, {oc.pystrip("CASE WHEN cut_at IS NULL THEN '' ELSE substr(text, 1, cut_at - 1) END")} AS block,
    CASE WHEN cut_at IS NULL THEN text ELSE substr(text, cut_at) END AS seg
  FROM (SELECT *, least({_at(_RECITAL)}, {_at(_NUMBER)}) AS cut_at FROM docs)),
heads AS (SELECT *, list_filter(list_transform(string_split(block, chr(10)), lambda x: {oc.pystrip('x')}),
    lambda x: length(x) > 3)[1] AS document_title FROM titled)"""

_EDGE = "' :.-'"
SECTIONS = f""",
pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k
  FROM (SELECT doc_id, string_split(regexp_replace(seg, {oc.q('(?m)(' + lex.SECTION_HEADING + ')')},
          chr(1) || '\\1' || chr(2), 'g'), chr(1)) AS p FROM titled)),
measured AS (
  SELECT doc_id, k, replace(piece, chr(2), '') AS whole, split_part(piece, chr(2), 1) AS head,
    sum(length(replace(piece, chr(2), ''))) OVER (PARTITION BY doc_id ORDER BY k) - length(replace(piece, chr(2), '')) AS start
  FROM pieces),
judged AS (
  SELECT *, trim({squeeze(oc.pystrip('head'))}, {_EDGE}) AS title, {oc.pystrip('whole')} AS body,
    regexp_matches(lower({oc.pystrip('head')}), {oc.q(lex.NUMBERED_HEADING)}) AS numbered
  FROM measured WHERE k > 1),
sections AS MATERIALIZED (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS sec_no, title, body AS text
  FROM (SELECT *, coalesce(bool_or(numbered) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING
          AND 1 PRECEDING), FALSE) AS earlier FROM judged)
  WHERE NOT (start < 300 AND NOT numbered AND NOT earlier) AND length(body) > 30
    AND NOT contains(upper(title), 'CONFIDENTIAL & PROPRIETARY') AND NOT contains(upper(title), 'PAGE '))"""


def docs(spark, sf_dir, divided=False):
    return prepare.with_title_block(corpus.documents(spark, sf_dir, divided))


@query("p2_split_title_block", DOCS + TITLED + " SELECT doc_id, document_title, md5(seg) AS rest FROM heads")
def p2(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", "document_title", F.md5("segmentable").alias("rest"))


@query("g1_segment_sections", DIVIDED + TITLED + SECTIONS + " SELECT doc_id, sec_no, title, text FROM sections")
def g1(spark, sf_dir):
    found = docs(spark, sf_dir, True).withColumn("sections", segment.section_chunks(F.col("segmentable")))
    return segment.section_rows(found).select("doc_id", *BIG("sec_no"), "title", "text")


_WINDOWS = f"""
paras AS (
  SELECT doc_id, list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: {oc.pystrip('p')}),
    lambda p: p <> '') AS ps FROM src),
counted AS (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM paras),
cw AS MATERIALIZED (SELECT *, {oc.nwords('p')} AS n FROM counted),
walk AS (
  SELECT doc_id, k, n AS used, 1 AS w FROM cw WHERE k = 1
  UNION ALL
  SELECT c.doc_id, c.k, CASE WHEN used + n > 350 THEN n ELSE used + n END, CASE WHEN used + n > 350 THEN w + 1 ELSE w END
  FROM walk JOIN cw c ON c.doc_id = walk.doc_id AND c.k = walk.k + 1),
windows AS (
  SELECT doc_id, w, string_agg(p, chr(10) || chr(10) ORDER BY k) AS text,
    {oc.pystrip("substr(split_part(arg_min(p, k), chr(10), 1), 1, 60)")} AS line
  FROM walk JOIN cw USING (doc_id, k) GROUP BY doc_id, w)"""


@query(
    "g2_paragraph_windows",
    "RECURSIVE src AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10)) AS text FROM documents)," + _WINDOWS + """
      SELECT doc_id, w AS sec_no, CASE WHEN length(line) > 5 THEN line ELSE 'Section ' || w END AS title,
        md5(text) AS digest FROM windows""",
)
def g2(spark, sf_dir):
    """The prose table has no blank lines, so every sentence becomes a paragraph."""
    prose = corpus.table(spark, sf_dir, "documents").select(
        "doc_id", F.replace("text", F.lit(". "), F.lit(".\n\n")).alias("text")
    )
    rows = segment.section_rows(prose.withColumn("sections", segment.paragraph_windows(F.col("text"))))
    return rows.select("doc_id", *BIG("sec_no"), "title", F.md5("text").alias("digest"))


@query(
    "g3_segment_or_window",
    "RECURSIVE " + DIVIDED.replace("docs AS MATERIALIZED", "contract_docs AS MATERIALIZED", 1) + """,
      docs AS MATERIALIZED (SELECT doc_id, text FROM contract_docs UNION ALL SELECT -1 - doc_id, text FROM documents)"""
    + TITLED + SECTIONS + """,
      n AS (SELECT doc_id, count(*) AS n FROM sections GROUP BY doc_id),
      src AS (SELECT t.doc_id, seg AS text FROM titled t LEFT JOIN n USING (doc_id) WHERE coalesce(n.n, 0) < 3),""" + _WINDOWS + """
      SELECT doc_id, sec_no, title, md5(text) AS digest FROM sections JOIN n USING (doc_id) WHERE n.n >= 3
      UNION ALL
      SELECT doc_id, w, CASE WHEN length(line) > 5 THEN line ELSE 'Section ' || w END, md5(text) FROM windows""",
)
def g3(spark, sf_dir):
    """Contracts (found by headings) and plain prose (packed into windows) together."""
    prose = corpus.table(spark, sf_dir, "documents").select((F.lit(-1) - F.col("doc_id")).alias("doc_id"), "text")
    both = corpus.documents(spark, sf_dir, True).select("doc_id", "text").unionByName(prose)
    rows = segment.section_rows(segment.segment_or_window(prepare.with_title_block(both)))
    return rows.select("doc_id", *BIG("sec_no"), "title", F.md5("text").alias("digest"))


# by construction: the generator knows its sub-clauses
_SUBS = DIVIDED + f""",
src AS (SELECT p.*, c.text AS txt, split_part(p.title, '. ', 2) AS parent, (doc_id + idx) % 5 AS form,
    array_to_string(regexp_extract_all(c.text, {oc.q(lex.WORD)})[1:5], ' ') AS five FROM parts p JOIN cl c USING (doc_id, idx)),
text_name AS (SELECT *, CASE WHEN starts_with(txt, '"') THEN '"' || split_part(txt, '"', 2) || '"'
    WHEN length(five) < 40 THEN five ELSE '' END AS nm FROM src),
made AS (
  SELECT doc_id, idx, parent, 1 AS sub_no, NULL AS num, NULL AS nm, title AS heading, body AS text FROM text_name WHERE form > 2
  UNION ALL SELECT doc_id, idx, parent, 1, idx || '.1', 'Scope', title, idx || '.1 Scope: ' || txt FROM text_name WHERE form = 0
  UNION ALL SELECT doc_id, idx, parent, 2, idx || '.2', 'The ' || idx, title,
      idx || '.2 The ' || lower(title) || ' rule is final and binding on all.' FROM text_name WHERE form = 0
  UNION ALL SELECT doc_id, idx, parent, 1, idx || '.1', '"Fees"', title, idx || '.1 "Fees" means all sums due.'
      FROM text_name WHERE form = 1
  UNION ALL SELECT doc_id, idx, parent, 2, idx || '.2', nm, title, idx || '.2 ' || txt FROM text_name WHERE form = 1
  UNION ALL SELECT doc_id, idx, parent, 1, idx || '.1', 'Order of Steps — Carve-Out', title,
      idx || '.1 Order of Steps — Carve-Out' FROM text_name WHERE form = 2
  UNION ALL SELECT doc_id, idx, parent, 2, idx || '.3', nm, title, idx || '.3 ' || txt FROM text_name WHERE form = 2),
subs AS MATERIALIZED (
  SELECT doc_id, idx AS sec_no, sub_no, num, nm, text, CASE WHEN num IS NULL THEN heading
      WHEN nm = '' THEN num || ' ' || parent
      WHEN len(list_filter(string_split(lower(parent), ' '), lambda w: length(w) > 4 AND contains(lower(nm), w))) > 0
        OR contains(lower(nm), lower(parent)) THEN num || ' ' || nm
      WHEN contains(parent, 'DEFINITIONS') AND starts_with(nm, '"') THEN num || ' Definitions — ' || nm
      ELSE num || ' ' || parent || ' — ' || nm END AS title
  FROM made)"""


def _subclauses(spark, sf_dir):
    return segment.subclause_rows(segment.segment_or_window(docs(spark, sf_dir, True)))


@query("g4_split_subclauses", _SUBS + " SELECT doc_id, sec_no, sub_no, text FROM subs")
def g4(spark, sf_dir):
    return _subclauses(spark, sf_dir).select("doc_id", *BIG("sec_no", "sub_no"), "text")


@query("g5_subclause_title", _SUBS + " SELECT doc_id, sec_no, sub_no, title FROM subs")
def g5(spark, sf_dir):
    return _subclauses(spark, sf_dir).select("doc_id", *BIG("sec_no", "sub_no"), "title")


@query("g6_subclause_name", _SUBS + " SELECT doc_id, sec_no, sub_no, nm AS name FROM subs WHERE num IS NOT NULL")
def g6(spark, sf_dir):
    rows = _subclauses(spark, sf_dir).withColumn("_no", F.regexp_extract("text", lex.SUBCLAUSE_START, 1)).where(F.col("_no") != "")
    line = F.split_part("text", F.lit("\n"), F.lit(1))
    return rows.select("doc_id", *BIG("sec_no", "sub_no"), segment.subclause_name(line, F.col("_no")).alias("name"))


@query(
    "g7_number_clauses",
    _SUBS + """ SELECT doc_id, row_number() OVER d AS idx, 'clause_' || row_number() OVER d AS clause_id, title, text
      FROM subs WINDOW d AS (PARTITION BY doc_id ORDER BY sec_no, sub_no)""",
)
def g7(spark, sf_dir):
    return segment.number_clauses(corpus.documents(spark, sf_dir, True)).select("doc_id", *BIG("idx"), "clause_id", "title", "text")


# -- S2, S3 -----------------------------------------------------------------
PAGES = oc.CLAUSES + """,
pages_raw AS (
  SELECT doc_id, page_no, string_agg(title || chr(10) || text, chr(10) || chr(10) ORDER BY idx) AS text
  FROM cl GROUP BY doc_id, page_no),
pg AS MATERIALIZED (
  SELECT doc_id, page_no, text FROM pages_raw
  UNION ALL SELECT doc_id, max(page_no) + 1, '' FROM pages_raw GROUP BY doc_id)"""


def pages(spark, sf_dir):
    return prepare.pages_of(corpus.paged_files(spark, sf_dir))


@query("s2_pages_of", PAGES + " SELECT doc_id, page_no, text FROM pg")
def s2(spark, sf_dir):
    return pages(spark, sf_dir).select("doc_id", *BIG("page_no"), "text")


@query("s3_assemble_full_text", PAGES + """ SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS text
  FROM pg WHERE text <> '' GROUP BY doc_id""")
def s3(spark, sf_dir):
    return prepare.assemble_full_text(pages(spark, sf_dir))


# -- G8, X7, P4-P10 ---------------------------------------------------------
# every third clause keeps its text, others have other white space, another ending, or another text altogether
_LOCATE = PAGES + """,
vary AS MATERIALIZED (
  SELECT doc_id, idx, clause_id, title, page_no AS true_page, text AS plain, CASE (doc_id + idx) % 4
    WHEN 0 THEN text WHEN 1 THEN upper(replace(text, ' ', '  ' || chr(10))) WHEN 2 THEN title || chr(10) || text || ' (amended)'
    ELSE 'Nowhere on any page stands this text.' END AS text FROM cl)"""


def varied(spark, sf_dir):
    form = (F.col("doc_id") + F.col("idx")) % 4
    return corpus.clauses(spark, sf_dir).withColumn(
        "text",
        F.when(form == 0, F.col("text"))
        .when(form == 1, F.upper(F.replace("text", F.lit(" "), F.lit("  \n"))))
        .when(form == 2, F.concat("title", F.lit("\n"), "text", F.lit(" (amended)")))
        .otherwise("Nowhere on any page stands this text."),
    )


@query("x7_containing_page", _LOCATE + """ SELECT v.doc_id, v.idx, CAST(min(p.page_no) AS BIGINT) AS found_page
  FROM vary v LEFT JOIN pg p ON p.doc_id = v.doc_id AND contains(p.text, v.text) GROUP BY ALL""")
def x7(spark, sf_dir):
    return spans.containing_page(varied(spark, sf_dir), pages(spark, sf_dir)).select("doc_id", *BIG("idx", "found_page"))


_PAIR = _LOCATE + """,
on_page AS (SELECT v.*, p.text AS page FROM vary v JOIN pg p ON p.doc_id = v.doc_id AND p.page_no = v.true_page),
located AS MATERIALIZED (
  SELECT *, instr(page, text) AS e, instr(lower(page), lower(plain)) AS l, CASE (doc_id + idx) % 4
    WHEN 0 THEN TRUE WHEN 1 THEN TRUE ELSE FALSE END AS there FROM on_page)"""


def on_page(spark, sf_dir):
    page = pages(spark, sf_dir).withColumnRenamed("text", "page")
    return varied(spark, sf_dir).join(page.hint("merge"), ["doc_id", "page_no"])


@query(
    "p4_find_offsets",
    _PAIR + """ SELECT doc_id, idx, CAST(CASE WHEN e > 0 THEN e - 1 WHEN there THEN l - 1 END AS BIGINT) AS start_offset,
      CAST(CASE WHEN e > 0 THEN e - 1 + length(text) WHEN there THEN l - 1 + length(plain) END AS BIGINT) AS end_offset
      FROM located""",
)
def p4(spark, sf_dir):
    found = on_page(spark, sf_dir).withColumn("s", spans.find_offsets(F.col("text"), F.col("page")))
    return found.select(
        "doc_id", *BIG("idx"), F.col("s.start").cast("bigint").alias("start_offset"), F.col("s.end").cast("bigint").alias("end_offset")
    )


_GIVEN = """, given AS (SELECT *, CAST(l - 1 AS BIGINT) AS s, CAST(l - 1 + length(plain) - idx % 2 AS BIGINT) AS e2 FROM located),
flat AS (SELECT *, lower(regexp_replace(page, '\\s+', ' ', 'g')) AS fp, trim(lower(regexp_replace(text, '\\s+', ' ', 'g'))) AS ft FROM given),
hits AS MATERIALIZED (SELECT *, trim(lower(regexp_replace(substr(page, s + 1, e2 - s), '\\s+', ' ', 'g'))) = ft AS valid,
  length(ft) >= 15 AND instr(fp, ft) > 0 AND instr(substr(fp, instr(fp, ft) + 1), ft) = 0 AS once FROM flat)"""


def given(spark, sf_dir):
    """Offsets as another system might hand them over: right for even positions, one short for odd ones."""
    plain = corpus.clauses(spark, sf_dir).select("doc_id", "idx", F.col("text").alias("plain"))
    rows = on_page(spark, sf_dir).join(plain.hint("merge"), ["doc_id", "idx"])
    at = F.expr("instr(lower(page), lower(plain))") - 1
    return rows.withColumns({"start_offset": at.cast("int"), "end_offset": (at + F.length("plain") - F.col("idx") % 2).cast("int")})


@query("p5_validate_offsets", _PAIR + _GIVEN + " SELECT doc_id, idx, CAST(valid AS BIGINT) AS valid FROM hits")
def p5(spark, sf_dir):
    ok = spans.validate_offsets(F.col("start_offset"), F.col("end_offset"), F.col("page"), F.col("text"))
    return given(spark, sf_dir).select("doc_id", *BIG("idx"), flag(ok).alias("valid"))


@query(
    "p6_safe_unique_span",
    _PAIR + _GIVEN + """ SELECT doc_id, idx, CASE WHEN once THEN s END AS start_offset,
      CASE WHEN once THEN s + length(plain) END AS end_offset FROM hits""",
)
def p6(spark, sf_dir):
    out = given(spark, sf_dir).withColumn("s", spans.safe_unique_span(F.col("page"), F.col("text")))
    return out.select("doc_id", *BIG("idx"), F.col("s.start").cast("bigint").alias("start_offset"), F.col("s.end").cast("bigint").alias("end_offset"))


@query(
    "p7_resolve_highlight_span",
    _PAIR + _GIVEN + """ SELECT doc_id, idx, CASE WHEN valid OR once THEN s END AS start_offset,
      CASE WHEN valid THEN e2 WHEN once THEN s + length(plain) END AS end_offset FROM hits""",
)
def p7(spark, sf_dir):
    span = spans.resolve_highlight_span(F.col("start_offset"), F.col("end_offset"), F.col("page"), F.col("text"))
    out = given(spark, sf_dir).withColumn("s", span)
    return out.select("doc_id", *BIG("idx"), F.col("s.start").cast("bigint").alias("start_offset"), F.col("s.end").cast("bigint").alias("end_offset"))


@query(
    "p8_highlightable",
    oc.ASSESSED + """ SELECT doc_id, idx FROM asd WHERE is_risk_bearing AND risk_level <> 'NEUTRAL'
      AND (risk_level IN ('HIGH', 'MEDIUM') OR unfairness >= 50 OR idx = 2)""",
)
def p8(spark, sf_dir):
    return assessed(spark, sf_dir).where(spans.highlightable(F.col("clause_id") == "clause_2")).select("doc_id", *BIG("idx"))


# spans of clauses, each stretched over part of the next one for odd positions
_SPANS = PAGES + """,
placed AS MATERIALIZED (SELECT c.doc_id, c.page_no, c.idx, instr(p.text, c.text) - 1 AS s,
    instr(p.text, c.text) - 1 + length(c.text) + CASE WHEN c.idx % 2 = 1 THEN 40 ELSE 0 END AS e
  FROM cl c JOIN pg p USING (doc_id, page_no)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY s, idx) AS k FROM placed),
kept AS (
  SELECT doc_id, page_no, k, idx, s, e, e AS last, TRUE AS keep FROM ordered WHERE k = 1
  UNION ALL
  SELECT o.doc_id, o.page_no, o.k, o.idx, o.s, o.e, CASE WHEN o.s < last THEN last ELSE o.e END, o.s >= last
  FROM kept JOIN ordered o ON o.doc_id = kept.doc_id AND o.page_no = kept.page_no AND o.k = kept.k + 1)"""


@query(
    "p9_non_overlapping_spans",
    "RECURSIVE " + _SPANS + """ SELECT doc_id, page_no, idx, s AS start_offset, e AS end_offset FROM kept WHERE keep""",
)
def p9(spark, sf_dir):
    page = pages(spark, sf_dir).withColumnRenamed("text", "page")
    at = F.expr("instr(page, text)") - 1
    placed = corpus.clauses(spark, sf_dir).join(page.hint("merge"), ["doc_id", "page_no"]).select(
        "doc_id", "page_no", "idx", at.cast("int").alias("start"),
        (at + F.length("text") + F.when(F.col("idx") % 2 == 1, 40).otherwise(0)).cast("int").alias("end"),
    )
    out = spans.non_overlapping_spans(placed)
    return out.select(
        "doc_id", *BIG("page_no", "idx"), F.col("start").cast("bigint").alias("start_offset"), F.col("end").cast("bigint").alias("end_offset")
    )


@query(
    "p10_page_text_or_rebuilt",
    PAGES + """ SELECT doc_id, page_no, coalesce(nullif(CASE WHEN page_no = 1 THEN '' ELSE pg.text END, ''), r.text, '') AS text
      FROM pg LEFT JOIN pages_raw r USING (doc_id, page_no)""",
)
def p10(spark, sf_dir):
    """The first page of every contract is taken as an unreadable scan."""
    scanned = pages(spark, sf_dir).withColumn("text", F.when(F.col("page_no") == 1, "").otherwise(F.col("text")))
    out = spans.page_text_or_rebuilt(corpus.clauses(spark, sf_dir), scanned)
    return out.select("doc_id", *BIG("page_no"), "text")


@query(
    "x8_clause_page_number",
    PAGES + """ SELECT c.doc_id, c.idx, c.page_no, length(p.text) AS page_chars
      FROM (SELECT doc_id, idx, CASE WHEN page_no > 1 THEN page_no ELSE 1 END AS page_no FROM cl) c JOIN pg p USING (doc_id, page_no)""",
)
def x8(spark, sf_dir):
    placed = corpus.clauses(spark, sf_dir).withColumn("page_no", F.coalesce(F.when(F.col("page_no") > 1, F.col("page_no")), F.lit(1)))
    sizes = pages(spark, sf_dir).select("doc_id", "page_no", F.length("text").alias("page_chars"))
    joined = placed.join(sizes.hint("merge"), ["doc_id", "page_no"])
    return joined.select("doc_id", *BIG("idx", "page_no", "page_chars"))


@query(
    "g8_attribute_page",
    "RECURSIVE " + _LOCATE + f""",
      pf AS (SELECT *, lower(regexp_replace(text, '\\s+', ' ', 'g')) AS flat FROM pg),
      facts AS MATERIALIZED (SELECT v.doc_id, v.idx,
        (SELECT min(page_no) FROM pf p WHERE p.doc_id = v.doc_id AND contains(p.text, v.text)) AS exact,
        (SELECT list(page_no ORDER BY page_no) FROM pf p WHERE p.doc_id = v.doc_id
           AND length(v.head) > 15 AND contains(p.flat, v.head)) AS starts,
        coalesce((SELECT min(page_no) FROM pf p WHERE p.doc_id = v.doc_id AND length(l1) > 18 AND contains(p.text, substr(l1, 1, 50))),
          (SELECT min(page_no) FROM pf p WHERE p.doc_id = v.doc_id AND length(l2) > 18 AND contains(p.text, substr(l2, 1, 50))),
          (SELECT min(page_no) FROM pf p WHERE p.doc_id = v.doc_id AND length(title) > 8
             AND contains(lower(p.text), lower(title)))) AS late
        FROM (SELECT *, lower(regexp_replace(substr(text, 1, 140), '\\s+', ' ', 'g')) AS head,
          split_part(text, chr(10), 1) AS l1, split_part(text, chr(10), 2) AS l2 FROM vary) v),
      walk AS (
        SELECT doc_id, 0 AS idx, 1::BIGINT AS page_no FROM contracts
        UNION ALL
        SELECT f.doc_id, f.idx, coalesce(exact, list_min(list_filter(starts, lambda p: p >= w.page_no)), list_min(starts), late, w.page_no)
        FROM walk w JOIN facts f ON f.doc_id = w.doc_id AND f.idx = w.idx + 1)
      SELECT doc_id, idx, page_no FROM walk WHERE idx > 0""",
)
def g8(spark, sf_dir):
    return spans.attribute_pages(varied(spark, sf_dir), pages(spark, sf_dir)).select("doc_id", *BIG("idx", "page_no"))


@query(
    "g9_pack_batches",
    "RECURSIVE " + oc.CLAUSES + """,
      sized AS MATERIALIZED (SELECT doc_id, idx, length(title) + length(text) AS n FROM cl),
      walk AS (
        SELECT doc_id, idx, 1 AS b, n AS used FROM sized WHERE idx = 1
        UNION ALL
        SELECT s.doc_id, s.idx, CASE WHEN used + s.n > 300 THEN b + 1 ELSE b END, CASE WHEN used + s.n > 300 THEN s.n ELSE used + s.n END
        FROM walk w JOIN sized s ON s.doc_id = w.doc_id AND s.idx = w.idx + 1)
      SELECT doc_id, idx, b AS batch_no FROM walk""",
)
def g9(spark, sf_dir):
    """The corpus has short contracts, so batches of 300 characters stand for the usual 6,000."""
    return batching.pack_batches(corpus.clauses(spark, sf_dir), 300).select("doc_id", *BIG("idx", "batch_no"))
