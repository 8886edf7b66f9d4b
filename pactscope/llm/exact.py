"""Exact duplicates by deterministic block naming.

A text is cut into blocks of fixed size. All blocks of the corpus are sorted and numbered, so that equal blocks and only
they share an integer. Pairs of neighbouring numbers are then sorted and numbered the same way, level by level, until one
number is left of each text: its identity, free of collisions because every name was given to compared contents.

The sort key of a block is its 64-bit hash, then its rank among the contents of that hash; contents of one hash are
compared byte by byte. Text is shuffled once, after equal blocks have been combined where they were read; all later steps
move numbers. Levels are as many as the binary logarithm of the blocks of the longest text.

Edge cases: a null text equals the empty text. Null ids never win over others; a group with null ids only has a null
keep_id. Rows that repeat id and text count each, and exactly one row of a group is kept. An empty table gives an empty
result. Other columns of the input are not looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactscope.llm.common import cut, fresh, numbered, small, text_bytes

#: Bytes of a block.
BLOCK = 4096


def _blocks(docs: DataFrame, block: int, hash_bits: int) -> DataFrame:
    """One row per block: doc_id, digest of the text (addresses the row, decides nothing), n blocks, pos, block, h."""
    texts = docs.select("doc_id", text_bytes().alias("data"))
    texts = texts.withColumns({
        "sha": F.unhex(F.sha2("data", 256)),
        "n": F.greatest(F.lit(1), F.ceil(F.length("data") / block)).cast("int"),
    })
    cuts = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(F.col("data"), i * block + 1, F.lit(block)))
    blocks = texts.select("doc_id", "sha", "n", F.posexplode(cuts).alias("pos", "block"))
    h = F.xxhash64("block")
    return blocks.withColumn("h", h if hash_bits == 64 else F.shiftrightunsigned(h, 64 - hash_bits))


def _ranked(blocks: DataFrame) -> DataFrame:
    """Blocks with c, the rank among the different contents that share the hash (0 where there is only one)."""
    contents = blocks.groupBy("h", "block").agg(F.count(F.lit(1)).alias("rows"))
    clashes = cut(contents.groupBy("h").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1").select("h"))
    if clashes.isEmpty():
        return blocks.withColumn("c", F.lit(0))
    several = blocks.join(small(clashes), "h", "left_semi").select("h", "block").distinct()
    rank = F.row_number().over(Window.partitionBy("h").orderBy("block"))
    ranks = cut(several.withColumn("c", rank))
    return blocks.join(small(ranks, 10_000), ["h", "block"], "left").withColumn("c", F.coalesce("c", F.lit(0)))


def identities(docs: DataFrame, block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """One row per doc_id and text: doc_id, sha, level, name, copies. (level, name) is equal for equal texts only.

    hash_bits below 64 makes different contents share a hash, for tests of the comparison.
    """
    words = _ranked(_blocks(docs, block, hash_bits)).select("doc_id", "sha", "n", "pos", "h", "c")
    rows = cut(words.groupBy("doc_id", "sha", "n", "pos", "h", "c").agg(F.count(F.lit(1)).alias("copies")))
    names = numbered(rows.select("h", "c"))
    at = cut(rows.join(names, ["h", "c"]).select("doc_id", "sha", "copies", "n", "pos", "name"))
    most = at.agg(F.max("n")).first()[0] or 1
    level, done = 0, []
    while True:
        done.append(at.filter("n = 1").select("doc_id", "sha", "copies", F.lit(level).alias("level"), "name"))
        if most == 1:
            return reduce(DataFrame.unionByName, done)
        half = at.filter("n > 1").groupBy(
            "doc_id", "sha", "copies", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.shiftright("pos", 1).alias("pos"),
        ).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("b"),
        )
        half = cut(half)
        names = numbered(half.select("a", "b"))
        at = cut(half.join(names, ["a", "b"]).select("doc_id", "sha", "copies", "n", "pos", "name"))
        most, level = (most + 1) // 2, level + 1


def exact_duplicates(docs: DataFrame, block: int = BLOCK, hash_bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (largest id of the equal texts), group_size, kept, text_sha256."""
    rows = identities(docs, block, hash_bits)
    groups = rows.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = cut(groups)
    each = rows.join(groups, ["level", "name"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def only_staying(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """docs without rows that don't stay and with one of those that stay repeatedly; columns as they are.

    verdicts: doc_id, text_sha256, stays, rows (how many rows of docs they are); rows of docs without a verdict stay.
    """
    key, sha, stays = fresh(docs, "dropped_id"), fresh(docs, "dropped_sha"), fresh(docs, "dropped_stays")
    dropped = verdicts.filter("not stays or rows > 1").select("doc_id", "text_sha256", "stays")
    dropped = cut(dropped.toDF(key, sha, stays))
    same = F.col("doc_id").eqNullSafe(F.col(key)) & (F.sha2(text_bytes(), 256) == F.col(sha))
    once = docs.join(small(dropped), same, "left_anti")
    again = dropped.filter(F.col(stays))
    if again.isEmpty():
        return once
    repeated = docs.join(small(again), same, "left_semi").dropDuplicates(["doc_id", "text"])
    return once.unionByName(repeated)


def keep_distinct(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of equal texts, the one with the largest id; columns as they are."""
    verdicts = cut(exact_duplicates(docs).select("doc_id", "text_sha256", "kept"))
    return only_staying(docs, verdicts.groupBy("doc_id", "text_sha256").agg(
        F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("rows"),
    ))
