"""Retrieval of clauses for questions.

A clause is indexed by one sparse column: a map from hashed words to counts, kept as
exact integers; cosine is taken at the end. A question meets the clauses of its contract
in one join on ``doc_id`` and the dot product is taken in that row, by looking up the
question's few words in the clause's map. Lists of clauses are windows over these pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactscope.functions.lexicon import EMBED_DIM, WORDS
from pactscope.functions.buckets import word_buckets
from pactscope.functions.text import contains_any, spaced, words_of
from pactscope.operators.predicates import is_global_risk_question, is_materially_risky
from pactscope.operators.ranking import reason_count, severity_order, top_per_group

QUESTION_KEYS = ["doc_id", "q_no"]


# -- V1, V2, A8: vectors ----------------------------------------------------
def index_text() -> Column:
    """V2: the text a clause is indexed by."""
    return F.concat(
        F.col("title"), F.lit("\n"), F.col("text"), F.lit("\n"), F.coalesce(F.col("summary"), F.lit(""))
    )


def sparse_vector(text: Column, dim: int = EMBED_DIM) -> Column:
    """Counts per bucket of a text's words, as array<struct<bucket, tf>> by bucket; at most ``dim`` entries."""
    return word_buckets(spaced(F.lower(text)), dim)


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0).cast("bigint"), lambda acc, e: acc + e["tf"] * e["tf"])


def postings(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """One row per (key, bucket) with its count and the squared norm of the whole vector."""
    rows = df.select(*keys, sparse_vector(text).alias("_v"))
    rows = rows.select(*keys, "_v", squared_norm(F.col("_v")).alias("norm2"))
    return rows.select(*keys, "norm2", F.inline_outer("_v")).where(F.col("bucket").isNotNull())


def term_frequencies(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    return postings(df, keys, text).select(*keys, "bucket", "tf")


def hash_embed(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """V1: L2-normalised weights; a text without words has no rows."""
    return postings(df, keys, text).select(
        *keys, "bucket", (F.col("tf") / F.sqrt(F.col("norm2").cast("double"))).alias("weight")
    )


def dense_cosine(a: Column, b: Column) -> Column:
    """V3 over dense unit vectors."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


# -- V3: cosine of questions and clauses ------------------------------------
def clause_vectors(clauses: DataFrame, *carried: Column | str) -> DataFrame:
    """The index of a contract's clauses: (doc_id, idx, carried columns, vector, norm2); vector maps buckets to counts.

    A table that has vectors already (one that was written, see ``streaming.audit``) is taken as it is.
    """
    if "vector" in clauses.columns:
        return clauses.select("doc_id", "idx", *carried, "vector", "norm2")
    entries = clauses.select("doc_id", "idx", *carried, sparse_vector(index_text()).alias("_v"))
    columns = [c for c in entries.columns if c != "_v"]
    return entries.select(*columns, F.map_from_entries("_v").alias("vector"), squared_norm(F.col("_v")).alias("norm2"))


def scored_pairs(questions: DataFrame, vectors: DataFrame, *asked: Column | str) -> DataFrame:
    """Every question with every clause of its contract: keys, ``asked`` columns of the question, idx and the carried columns
    of the clause, dot, score (0 where they share no word)."""
    words = questions.select(*QUESTION_KEYS, *asked, sparse_vector(F.col("message")).alias("_q"))
    words = words.withColumn("_q_norm2", squared_norm(F.col("_q")))
    dot = F.aggregate(
        "_q", F.lit(0).cast("bigint"),
        lambda acc, e: acc + e["tf"] * F.coalesce(F.try_element_at("vector", e["bucket"]), F.lit(0).cast("bigint")),
    )
    score = F.coalesce(F.col("dot") / F.sqrt(F.nullif(F.col("_q_norm2") * F.col("norm2"), F.lit(0)).cast("double")), F.lit(0.0))
    pairs = words.join(vectors.hint("merge"), "doc_id").withColumn("dot", dot).withColumn("score", score)
    return pairs.drop("_q", "_q_norm2", "vector", "norm2")


def cosine_scores(questions: DataFrame, clauses: DataFrame) -> DataFrame:
    """V3: (doc_id, q_no, idx, dot, score) for pairs that share a bucket."""
    return scored_pairs(questions, clause_vectors(clauses)).where(F.col("dot") > 0).select(*QUESTION_KEYS, "idx", "dot", "score")


# -- W2 ---------------------------------------------------------------------
def _by_score() -> list[Column]:
    return [F.col("score").desc(), F.col("idx")]


def retrieve_top_k(questions: DataFrame, clauses: DataFrame, k: int = 4) -> DataFrame:
    """Up to k clauses per question as (doc_id, q_no, idx, pos).

    A contract with at most k clauses gives all of them in document order, otherwise the k best by cosine
    (ties in document order). One candidate more than k tells the two cases apart.
    """
    pairs = scored_pairs(questions, clause_vectors(clauses)).select(*QUESTION_KEYS, "idx", "score")
    best = top_per_group(pairs, QUESTION_KEYS, _by_score(), k + 1, rank="_rank")
    whole = F.max("_rank").over(Window.partitionBy(*QUESTION_KEYS)) <= k
    return (
        best.withColumn("_whole", whole)
        .where(F.col("_rank") <= k)
        .select(*QUESTION_KEYS, "idx", F.when(F.col("_whole"), F.col("idx")).otherwise(F.col("_rank")).alias("pos"))
    )


def _with_retrieved(pairs: DataFrame, k: int) -> DataFrame:
    """pairs with ``_pos``, the place of a clause among the k retrieved ones (see W2), null for all others."""
    questions = Window.partitionBy(*QUESTION_KEYS)
    ranked = pairs.withColumns({
        "_rank": F.row_number().over(questions.orderBy(*_by_score())), "_n": F.count(F.lit(1)).over(questions),
    })
    place = F.when(F.col("_n") <= k, F.col("idx")).otherwise(F.col("_rank"))
    return ranked.withColumn("_pos", F.when(F.col("_rank") <= k, place)).drop("_rank", "_n")


# -- X9 ---------------------------------------------------------------------
def selected_clauses(questions: DataFrame, clauses: DataFrame) -> DataFrame:
    """The clause a question points at, found by its id, with the positions of the clauses before and after it."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    placed = clauses.select(
        "doc_id", F.col("clause_id").alias("selected_clause_id"), "idx",
        F.lag("idx").over(order).alias("_before"), F.lead("idx").over(order).alias("_after"),
    )
    wanted = questions.where(F.col("selected_clause_id").isNotNull()).select(*QUESTION_KEYS, "selected_clause_id")
    return wanted.join(placed.hint("merge"), ["doc_id", "selected_clause_id"]).drop("selected_clause_id")


def clause_with_neighbours(questions: DataFrame, clauses: DataFrame) -> DataFrame:
    """The selected clause (ord 1), the one before (2) and the one after (3), where they exist."""
    steps = F.array(*[F.struct(F.lit(o).alias("ord"), F.col(c).alias("idx")) for o, c in ((1, "idx"), (2, "_before"), (3, "_after"))])
    return (
        selected_clauses(questions, clauses).select(*QUESTION_KEYS, F.inline(steps))
        .where(F.col("idx").isNotNull()).select(*QUESTION_KEYS, "idx", "ord")
    )


# -- U1 ---------------------------------------------------------------------
def ordered_union(*lists: DataFrame, limit: int | None = None) -> DataFrame:
    """Lists (doc_id, q_no, idx, pos) one after another, each clause once, renumbered from 1."""
    tagged = None
    for i, part in enumerate(lists):
        rows = part.select(*QUESTION_KEYS, "idx", F.struct(F.lit(i).alias("l"), F.col("pos").cast("int").alias("p")).alias("_at"))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    once = tagged.groupBy(*QUESTION_KEYS, "idx").agg(F.min("_at").alias("_at"))
    window = Window.partitionBy(*QUESTION_KEYS).orderBy("_at", "idx")
    out = once.withColumn("pos", F.row_number().over(window)).drop("_at")
    return out if limit is None else out.where(F.col("pos") <= limit)


# -- W3, W4: chat context ---------------------------------------------------
def global_context(questions: DataFrame, assessed: DataFrame, k: int = 7) -> DataFrame:
    """For questions about overall risk, material clauses by level, score, similarity and reasons.

    Similarity only breaks ties: whether a clause is among the ``rag`` most similar ones.
    """
    rag = max(k, 5)
    asked = questions.where(is_global_risk_question(F.col("message")))
    vectors = clause_vectors(assessed, is_materially_risky().alias("_material"), "risk_level", "unfairness", reason_count().alias("_reasons"))
    placed = _with_retrieved(scored_pairs(asked, vectors), rag).where("_material")
    order = [*severity_order(), F.col("_pos").isNull(), F.col("_reasons").desc(), F.col("idx")]
    return top_per_group(placed, QUESTION_KEYS, order, k, rank="pos").select(*QUESTION_KEYS, "idx", "pos")


def focus_context(questions: DataFrame, clauses: DataFrame, k: int = 7) -> DataFrame:
    """The selected clause and its neighbours, then the retrieved clauses."""
    pairs = scored_pairs(questions, clause_vectors(clauses, "clause_id"), "selected_clause_id")
    chosen = F.coalesce(F.col("clause_id") == F.col("selected_clause_id"), F.lit(False))
    order = Window.partitionBy(*QUESTION_KEYS).orderBy("idx")
    pairs = pairs.withColumn("_chosen", chosen)
    near = F.when(F.col("_chosen"), 1).when(F.lead("_chosen").over(order), 2).when(F.lag("_chosen").over(order), 3)
    placed = _with_retrieved(pairs.withColumn("_near", near), k).where(F.col("_near").isNotNull() | F.col("_pos").isNotNull())
    final = Window.partitionBy(*QUESTION_KEYS).orderBy(F.col("_near").asc_nulls_last(), "_pos", "idx")
    return placed.withColumn("pos", F.row_number().over(final)).select(*QUESTION_KEYS, "idx", "pos")


def chat_context(questions: DataFrame, assessed: DataFrame, k: int = 7) -> DataFrame:
    """W3 for questions about overall risk, W4 for all others."""
    focused = questions.where(~is_global_risk_question(F.col("message")))
    return global_context(questions, assessed, k).unionByName(focus_context(focused, assessed, k))


# -- A7, W5: keyword context ------------------------------------------------
def question_words(message: Column) -> Column:
    """Lower-case words longer than three characters, repeats kept."""
    return F.transform(F.filter(words_of(message), lambda w: F.length(w) > 3), lambda w: F.lower(w))


def _keyword_pairs(questions: DataFrame, clauses: DataFrame) -> DataFrame:
    """Every question with every clause of its contract: keys, idx, whether it is the selected one, hits."""
    asked = questions.select(*QUESTION_KEYS, "selected_clause_id", question_words(F.col("message")).alias("_words"))
    said = clauses.select("doc_id", "idx", "clause_id", F.lower(F.concat("title", F.lit(" "), "text")).alias("_said"))
    hits = F.size(F.filter("_words", lambda w: F.contains(F.col("_said"), w)))
    chosen = F.coalesce(F.col("clause_id") == F.col("selected_clause_id"), F.lit(False))
    return asked.join(said.hint("merge"), "doc_id").select(*QUESTION_KEYS, "idx", chosen.alias("chosen"), hits.alias("hits"))


def keyword_hits(questions: DataFrame, clauses: DataFrame) -> DataFrame:
    """How many question words occur in title and text; clauses without any are left out."""
    return _keyword_pairs(questions, clauses).where(F.col("hits") > 0).drop("chosen")


def keyword_context(questions: DataFrame, clauses: DataFrame, k: int = 7) -> DataFrame:
    """The selected clause, then clauses by keyword hits, then document order, k in all."""
    order = [F.col("chosen").desc(), F.col("hits").desc(), F.col("idx")]
    return top_per_group(_keyword_pairs(questions, clauses), QUESTION_KEYS, order, k, rank="pos").select(*QUESTION_KEYS, "idx", "pos")


# -- W6: scenario context ---------------------------------------------------
def scenario_context(prompts: DataFrame, assessed: DataFrame, k: int = 7, limit: int = 9) -> DataFrame:
    """K retrieved clauses; prompts about leaving or not paying also get exit and payment clauses up to ``limit``."""
    vectors = clause_vectors(assessed, F.col("category").isin("TERMINATION", "PAYMENT_TERMS").alias("_relevant"))
    about_exit = contains_any(F.lower("message"), WORDS["scenario_exit"]).alias("_exit")
    placed = _with_retrieved(scored_pairs(prompts, vectors, about_exit), k)
    wanted = placed.where(F.col("_pos").isNotNull() | (F.col("_exit") & F.col("_relevant")))
    order = [F.col("_pos").asc_nulls_last(), F.col("idx")]
    return top_per_group(wanted, QUESTION_KEYS, order, limit, rank="pos").select(*QUESTION_KEYS, "idx", "pos")
