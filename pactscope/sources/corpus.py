"""Contracts, clauses, pages and chat inputs that Spark derives from the given tables.

The given text tables hold no legal language, so a deterministic contract
corpus is spread over ``orders``: one contract per order, 4 to 12 clauses each,
every clause an instance of one of a list of templates. The same formulas can be
written in any SQL dialect. All of it is a narrow projection of one scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Clause templates (title, text)
TEMPLATES: list[tuple[str, str]] = [
    ("INDEMNITY", "Contractor shall indemnify and hold harmless Client from any and all losses and attorney fees."),
    ("MUTUAL INDEMNITY", "Each party shall indemnify the other for losses caused by its own negligence."),
    ("CAPPED INDEMNITY", "Contractor shall indemnify Client for any and all claims, capped at the fees paid."),
    ("NEGATED INDEMNITY",
     "Contractor shall indemnify Client for any and all losses but shall not pay punitive damages."),
    ("REFERRED INDEMNITY", "Contractor shall indemnify Client for any and all claims, subject to Section {ref}."),
    ("LIABILITY CAP", "Liability under this Agreement is limited to fees received."),
    ("WORK PRODUCT",
     "All deliverables are work made for hire and Contractor hereby assigns all rights immediately upon creation."),
    ("PAID WORK PRODUCT", "Contractor assigns all deliverables to Client upon full payment."),
    ("INVENTIONS", "Contractor transfers the inventions to Client as described in Exhibit B."),
    ("TERM",
     "This Agreement commences on the signing day and shall remain in effect for an initial period of one year."),
    ("RATE FREEZE", "The initial term commences on signing and fees cannot be increased during any extension."),
    ("ROLLOVER",
     "This Agreement shall automatically renew for successive terms unless Contractor gives written notice 90 days "
     "before expiry."),
    ("SOLE RENEWAL", "Client has the sole option to renew this Agreement."),
    ("EXIT",
     "Client may terminate at any time without notice or penalty and Contractor shall forfeit unbilled work."),
    ("EXIT WITH NOTICE",
     "Client may terminate at any time upon 10 days written notice and Contractor shall forfeit unbilled work."),
    ("EXIT IN WORDS", "Client may terminate at any time upon thirty (30) days prior written notice."),
    ("CONVENIENCE", "Company may terminate for convenience on written notice."),
    ("PAYMENT", "Client shall pay each invoice on net 90 terms and may withhold any disputed portion."),
    ("PROMPT PAYMENT", "Client shall pay each invoice within 30 days of receipt."),
    ("ENTRY", "Landlord may enter premises unannounced at any hour."),
    ("DEPOSIT", "Landlord keeps the deposit for carpet wear and tear."),
    ("PRECEDENCE", "In any conflict the purchase order shall control over this Agreement."),
    ("DISPUTES", "The parties shall submit any dispute to arbitration in the county seat."),
    ("DEFINITIONS", '"Services" means the tasks listed in Exhibit A.'),
    ("COPIES", "This document may be executed in counterparts, including by electronic signature."),
    ("BACKGROUND", "WHEREAS, the parties wish to work together on a project."),
]

# Further clause templates, for rules that the ones above never reach
RARE_TEMPLATES: list[tuple[str, str]] = [
    ("NO INDEMNITY", "Contractor shall not indemnify Client for any loss of data."),
    ("LOCK", "Neither party may terminate without cause and neither party shall sublet the rooms."),
    ("RESTRAINT", "Neither party shall solicit the staff of the other."),
    ("DISCLAIMER", "Each party shall not be liable for indirect damages."),
    ("BACKGROUND IP", "Whatever a side brought along stays its own and all deliverables may use it."),
    ("SPECIFICATION", "The deliverables must meet the specification in Exhibit C."),
    ("TERM WITH LOSS", "This Agreement commences on the signing day and Contractor shall forfeit the bond on early expiry."),
    ("TERM BY CHOICE", "This Agreement commences on the signing day, and Client may extend it without consent."),
    ("ROLLOVER WITH LOSS", "This Agreement shall automatically renew and no compensation is owed for the last month."),
    ("CUSTOMARY RENEWAL", "This Agreement shall renew for successive terms when both parties agree."),
    ("MUTUAL EXIT", "Either party may terminate this Agreement for cause."),
    ("NO EARLY EXIT", "Client shall not terminate this Agreement before the first anniversary."),
    ("EXIT FOR CAUSE", "Client may terminate this Agreement for cause."),
    ("EXIT UNDER TERMS", "Client may terminate this Agreement for cause, subject to Section {ref}."),
    ("INSPECTION", "Landlord makes a routine inspection each spring."),
    ("SCHEDULE", "Part Two"),
    ("LAW", "This Agreement is governed by the laws of the State of Ohio."),
    ("NOTICES", "Notices shall be in writing and addressed to the parties."),
    ("SEVERABILITY", "If any provision is found invalid the remaining provisions shall continue."),
    ("WHOLE AGREEMENT", "This is the entire agreement and supersedes all prior understandings."),
    ("MEANINGS", "As defined in Section {ref}."),
    ("RANK OF PARTS", "This part shall prevail in any conflict with Section {ref}."),
    ("ADDED DUTIES", "In addition to Section {ref} the staff is trained twice a year."),
    ("MENTION", "Tools are listed near Section {ref} of the annex."),
    ("EASED INDEMNITY", "Contractor shall indemnify Client for any and all claims after 30 days written notice, subject to Section {ref}."),
    ("WAIVER", "Waiver of any breach is no waiver of later ones and headings are for convenience only."),
]
ALL_TEMPLATES = TEMPLATES + RARE_TEMPLATES

# Questions asked about contracts
QUESTIONS: list[str] = [
    "What are the biggest risks in this agreement?",
    "Rank the riskiest clauses and list your top 5 concerns",
    "Where am I most exposed?",
    "Give me a risk summary, please",
    "Can the client terminate without notice or penalty?",
    "What does clause 3 say about the highest risk?",
    "Who owns the deliverables upon full payment?",
    "What happens to unpaid invoices if the client cancels midway?",
]

CLAUSE_KEYS = ["doc_id", "idx"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract per order: id, clause count, file name, size, order status.

    Contracts are dealt out by id while they are a few numbers; whatever is derived from them stays with its contract, and
    steps by contract find it there. The number of parts is the session's own, since sizes say nothing yet here.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return contracts_of(table(spark, sf_dir, "orders").repartition(parts, "o_orderkey"))


def contracts_of(orders: DataFrame) -> DataFrame:
    """The same over any batch or stream of orders."""
    key = F.col("o_orderkey")
    stem = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.lit("Apartment_Lease_"), key, F.lit(".pdf")))
        .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit("mutual_nda_"), key, F.lit(".DOCX")))
        .when(F.col("o_orderpriority") == "3-MEDIUM", F.concat(F.lit("services_agreement_"), key, F.lit(".pdf")))
        .when(F.col("o_orderpriority") == "5-LOW", F.concat(F.lit("statement_of_work_"), key, F.lit(".txt")))
        .otherwise(F.concat(F.lit("price_list_"), key, F.lit(".xlsx")))
    )
    return orders.select(
        key.alias("doc_id"),
        (F.lit(4) + key % 9).cast("int").alias("n_clauses"),
        stem.alias("filename"),
        F.when(F.col("o_orderstatus") == "P", F.lit(0))
        .otherwise(F.round(F.col("o_totalprice") * 100))
        .cast("bigint")
        .alias("size_bytes"),
        F.col("o_orderstatus").alias("status"),
    )


def clause_columns(doc_id: Column, n: Column, idx: Column, templates: list[tuple[str, str]] = TEMPLATES) -> dict[str, Column]:
    number = ((doc_id * 7 + idx * 11) % len(templates)).cast("int")
    ref = (1 + (doc_id + idx) % n).cast("string")
    title, text = (F.get(F.array(*[F.lit(t[field]) for t in templates]), number) for field in (0, 1))
    return {"title": F.concat(idx.cast("string"), F.lit(". "), title), "text": F.replace(text, F.lit("{ref}"), ref)}


def clauses(spark: SparkSession, sf_dir: str, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """Unscored clauses of the corpus, keyed by (doc_id, idx)."""
    rows = contracts(spark, sf_dir).select(
        "doc_id", "n_clauses", F.explode(F.sequence(F.lit(1), F.col("n_clauses"))).alias("idx")
    )
    cols = clause_columns(F.col("doc_id"), F.col("n_clauses"), F.col("idx"), templates)
    return rows.select(
        "doc_id",
        "idx",
        F.concat(F.lit("clause_"), F.col("idx")).alias("clause_id"),
        cols["title"].alias("title"),
        cols["text"].alias("text"),
        (F.lit(1) + F.floor((F.col("idx") - 1) / 3)).cast("int").alias("page_no"),
        F.lit(None).cast("int").alias("start_offset"),
        F.lit(None).cast("int").alias("end_offset"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two questions per contract, the first one asked with a clause selected."""
    texts = F.array(*[F.lit(m) for m in QUESTIONS])
    numbered = contracts(spark, sf_dir).select("doc_id", "n_clauses", F.explode(F.array(F.lit(1), F.lit(2))).alias("q_no"))
    return numbered.select(
        "doc_id",
        "q_no",
        F.get(texts, ((F.col("doc_id") + 3 * F.col("q_no")) % len(QUESTIONS)).cast("int")).alias("message"),
        F.when(
            F.col("q_no") == 1, F.concat(F.lit("clause_"), (1 + F.col("doc_id") % F.col("n_clauses")).cast("string"))
        ).alias("selected_clause_id"),
    )


def answer_text(doc_id: Column, n: Column) -> Column:
    """A raw chat answer with citation markers, some invalid, repeated or cut off."""
    first, second = (1 + doc_id % n).cast("string"), (1 + (doc_id + 1) % n).cast("string")
    tail = F.when(doc_id % 3 == 0, " end [CIT").when(doc_id % 3 == 1, " end [CITE:clause_").otherwise(" end [")
    return F.concat(
        F.lit("Risk in [CITE:clause_"), first, F.lit("] is high , see [CITE:clause_"), second,
        F.lit("] and [CITE:clause_99] or [CITE:clause_"), first, F.lit("]. Keep [note] here"), tail,
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw answer per contract with the clause ids it may cite."""
    return answers_of(contracts(spark, sf_dir))


def answers_of(contract_rows: DataFrame) -> DataFrame:
    ids = F.transform(F.sequence(F.lit(1), F.col("n_clauses")), lambda i: F.concat(F.lit("clause_"), i))
    return contract_rows.select(
        "doc_id", answer_text(F.col("doc_id"), F.col("n_clauses")).alias("raw"), ids.alias("allowed")
    )


def message_chunks(messages: DataFrame) -> DataFrame:
    """Messages (msg_id, text) cut at blanks: (msg_id, seq, chunk, last)."""
    parts = F.split("text", " ")
    rows = messages.select(
        "msg_id", F.size(parts).alias("n"), F.posexplode_outer(parts).alias("seq", "w")
    )
    last = F.col("seq") == F.col("n") - 1
    return rows.select("msg_id", "seq", F.when(last, F.col("w")).otherwise(F.concat("w", F.lit(" "))).alias("chunk"), last.alias("last"))


def _body(doc_id: Column, n: Column, idx: Column, divided: bool) -> Column:
    """Title line and text of a clause inside a document; ``divided`` puts sub-clauses into some of them."""
    cols = clause_columns(doc_id, n, idx)
    if not divided:
        return F.concat(cols["title"], F.lit("\n"), cols["text"])
    i, form = idx.cast("string"), (doc_id + idx) % 5
    text = (
        F.when(form == 0, F.concat(i, F.lit(".1 Scope: "), cols["text"], F.lit("\n"), i, F.lit(".2 The "),
                                   F.lower(cols["title"]), F.lit(" rule is final and binding on all.")))
        .when(form == 1, F.concat(i, F.lit('.1 "Fees" means all sums due.\n'), i, F.lit(".2 "), cols["text"]))
        .when(form == 2, F.concat(F.lit("Preamble.\n"), i, F.lit(".1 Order of Steps — Carve-Out\n"), i, F.lit(".2 short\n"),
                                  i, F.lit(".3 "), cols["text"]))
        .otherwise(cols["text"])
    )
    return F.concat(cols["title"], F.lit("\n"), text)


def documents(spark: SparkSession, sf_dir: str, divided: bool = False) -> DataFrame:
    """Whole contract texts: a title line, then every clause under its numbered heading."""
    return documents_of(contracts(spark, sf_dir), divided)


def documents_of(contract_rows: DataFrame, divided: bool = False) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_clauses")
    parts = F.transform(F.sequence(F.lit(1), n), lambda i: _body(d, n, i, divided))
    return contract_rows.select(
        "doc_id",
        "filename",
        F.concat(F.lit("SERVICES AGREEMENT "), d, F.lit("\n\n"), F.array_join(parts, "\n\n")).alias("text"),
    )


def paged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File texts with form feeds between pages of three clauses and a blank page at the end."""
    return paged_files_of(contracts(spark, sf_dir))


def paged_files_of(contract_rows: DataFrame) -> DataFrame:
    d, n = F.col("doc_id"), F.col("n_clauses")
    page_count = F.ceil(n / 3).cast("int")

    def page(p: Column) -> Column:
        members = F.transform(
            F.sequence(p * 3 - 2, F.least(p * 3, n)), lambda i: _body(d, n, i, False)
        )
        return F.array_join(members, "\n\n")

    pages = F.transform(F.sequence(F.lit(1), page_count), page)
    return contract_rows.select(
        "doc_id", "filename", F.concat(F.array_join(pages, "\r\n\f"), F.lit("\f  \n")).alias("file_text")
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outside verdicts as JSON text, two batches per contract; contracts of status P were never reviewed.

    Short clauses get no verdict, some get two, some payloads are fenced, wrapped in prose or cut off, and some
    name a level that does not exist.
    """
    d, idx = F.col("doc_id"), F.col("idx")
    levels = F.array(*[F.lit(x) for x in ("HIGH", "MEDIUM", "LOW", "NEUTRAL")])
    level = F.when((d % 11 == 3) & (idx == 2), "SEVERE").otherwise(F.get(levels, idx % 4))

    def verdict(score: Column) -> Column:
        return F.struct(
            F.concat(F.lit("clause_"), idx).alias("clause_id"),
            F.concat(F.lit("Reviewed "), idx).alias("title"),
            level.alias("risk_level"),
            score.alias("unfairness_score"),
            F.when(idx % 3 == 1, "LIABILITY").alias("category"),
            F.when(idx % 2 == 1, F.concat(F.lit("Outside view of clause "), idx)).alias("plain_english_summary"),
            F.when(idx % 4 == 0, F.concat(F.lit("Strike clause "), idx)).alias("suggested_pushback"),
            F.when(idx % 4 < 2, F.array(F.lit("Outside reason"))).alias("risk_reasons"),
        )

    score = (d + 17 * idx) % 101
    twice = F.array(verdict(score), verdict((d + 17 * idx + 7) % 101))
    batch = F.when(idx <= 3, 0).otherwise(1)
    status = contracts(spark, sf_dir).where(F.col("status") != "P").select("doc_id")
    rows = clauses(spark, sf_dir).where(F.length("text") >= 60).join(status.hint("merge"), "doc_id")
    per_batch = (
        rows.select("doc_id", batch.alias("batch_no"), "idx", F.when(idx % 5 == 1, twice).otherwise(F.slice(twice, 1, 1)).alias("v"))
        .groupBy("doc_id", "batch_no")
        .agg(F.flatten(F.array_sort(F.collect_list(F.struct("idx", "v")))["v"]).alias("clauses"))
    )
    b = F.col("batch_no")
    payload = F.to_json(
        F.struct(
            F.when((b == 1) & (d % 3 == 0), "n/a").otherwise(((d * (13 + 16 * b)) % 101).cast("string")).alias("overall_fairness_score"),
            F.when((b == 1) & (d % 2 == 0), "").otherwise(F.concat(F.lit("Part "), b, F.lit(" of "), d, F.lit("."))).alias("summary_overview"),
            "clauses",
        )
    )
    wrapped = (
        F.when(d % 7 == 0, F.concat(F.lit("```json\n"), payload, F.lit("\n```")))
        .when(d % 7 == 1, F.concat(F.lit("Here is the audit: "), payload, F.lit(" Done.")))
        .when(d % 7 == 2, F.concat(F.lit("{"), payload))
        .otherwise(payload)
    )
    return per_batch.select("doc_id", "batch_no", wrapped.alias("json"))


def client_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause lists as a client might send them: one JSON array per contract, mixed key styles, gaps."""
    d, n = F.col("doc_id"), F.col("n_clauses")
    levels = F.array(*[F.lit(x) for x in ("HIGH", "MEDIUM", "low", "NEUTRAL", "ODD")])
    kinds = F.array(F.lit("OPERATIVE"), F.lit("DEFINITION"), F.lit("RECITAL"))

    def item(i: Column) -> Column:
        cols, odd = clause_columns(d, n, i), i % 2 == 1
        return F.struct(
            F.when(odd, F.concat(F.lit("c"), i)).alias("id"),
            F.when(i % 3 > 0, cols["title"]).alias("title"),
            F.when(odd, cols["text"]).alias("originalText"),
            F.when(~odd, cols["text"]).alias("text"),
            F.when(odd, F.get(levels, ((d + i) % 5).cast("int"))).alias("riskLevel"),
            F.when(~odd & (i % 4 == 0), F.get(levels, ((d + i) % 5).cast("int"))).alias("risk_level"),
            F.when(odd, F.get(kinds, ((d + i) % 3).cast("int"))).alias("clauseKind"),
            F.when(i % 4 == 1, F.lit(False)).alias("isRiskBearing"),
            F.when(i % 4 == 2, F.lit(True)).alias("is_risk_bearing"),
            F.when(i % 3 == 0, (d + i) % 101).alias("unfairnessScore"),
            F.when(i % 5 == 1, (d + 2 * i) % 101).alias("unfairness_score"),
            F.when(i % 3 == 1, F.array(F.lit("one"), F.lit("two"))).alias("riskReasons"),
            F.when(i % 5 == 2, F.lit("scalar reason")).alias("risk_reasons"),
            F.when(i % 2 == 0, "").otherwise("Short.").alias("plainSummary"),
            F.when(i % 6 == 0, F.lit("From the server.")).alias("plain_english_summary"),
            F.when(i % 4 == 3, F.lit("TERMINATION_RIGHTS")).alias("category"),
            F.when(i % 2 == 0, i).alias("pageNumber"),
        )

    return contracts(spark, sf_dir).select(
        "doc_id", "filename", "n_clauses", F.to_json(F.transform(F.sequence(F.lit(1), n), item)).alias("json")
    )
