"""Batches of clauses for an outside reviewer, by characters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactscope.functions.lexicon import BATCH_CHARS
from pactscope.functions.walks import group_begins


def pack_batches(clauses: DataFrame, max_chars: int = BATCH_CHARS) -> DataFrame:
    """(doc_id, idx, batch_no); clauses fill a batch in order, one that does not fit starts the next.

    Only positions and lengths of a document's clauses are gathered, never texts.
    """
    size = F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("text", F.lit("")))
    listed = clauses.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("idx"), size.alias("n")))).alias("_c")
    )
    begun = listed.withColumn("_begins", group_begins(F.col("_c.n"), max_chars))
    after = F.concat(F.slice("_begins", F.lit(2), F.size("_begins")), F.array(F.size("_c")))
    batches = F.arrays_zip(F.col("_begins").alias("begin"), after.alias("end"))
    rows = begun.select("doc_id", "_c", F.posexplode(batches).alias("_no", "_b"))
    members = F.slice("_c", F.col("_b.begin") + 1, F.col("_b.end") - F.col("_b.begin"))
    return rows.select("doc_id", (F.col("_no") + 1).alias("batch_no"), F.inline(members)).select("doc_id", "idx", "batch_no")


def batch_payloads(clauses: DataFrame, batches: DataFrame) -> DataFrame:
    """One JSON array of clauses per batch."""
    item = F.struct("idx", F.struct("clause_id", "title", "text").alias("c"))
    rows = clauses.join(batches.hint("merge"), ["doc_id", "idx"]).groupBy("doc_id", "batch_no").agg(
        F.array_sort(F.collect_list(item), lambda a, b: a["idx"] - b["idx"]).alias("_c")
    )
    return rows.select("doc_id", "batch_no", F.size("_c").alias("n"), F.to_json(F.col("_c.c")).alias("payload"))
