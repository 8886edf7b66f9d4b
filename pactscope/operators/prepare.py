"""Text preparation of documents (P1-P3, P12) and page assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.functions import lexicon as lex
from pactscope.functions.text import strip, words_of

LETTER = r"[\p{L}\p{N}_]"


def clean_text(text: Column) -> Column:
    """One kind of line end, bullets restored, words cut at a line end joined, trimmed."""
    lines = F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    bullets = F.replace(lines, F.lit("(cid:127)"), F.lit("•"))
    return strip(F.regexp_replace(bullets, rf"({LETTER}+)-\n({LETTER}+)", "$1$2"))


def decode_text(content: Column) -> Column:
    """UTF-8 bytes to text; bytes that are no valid UTF-8 are dropped."""
    raw = content.cast("string")
    kept = F.replace(raw, F.lit("�"), F.lit("﷐"))
    repaired = F.replace(F.make_valid_utf8(kept), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(repaired, F.lit("﷐"), F.lit("�")))


def with_title_block(documents: DataFrame) -> DataFrame:
    """``document_title`` and ``segmentable``, the text from the first recital or numbered heading on."""
    text = F.col("text")

    def position(pattern: str) -> Column:
        return F.nullif(F.regexp_instr(text, F.lit("(?dmi)" + pattern)), F.lit(0))

    start = F.least(position(lex.RECITALS_LINE), position(lex.NUMBERED_LINE))  # least() skips nulls
    with_start = documents.withColumn("_start", start)
    head = F.when(F.col("_start").isNotNull(), strip(F.substring(text, F.lit(1), F.col("_start") - 1))).otherwise("")
    lines = F.filter(F.transform(F.split(head, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip), lambda x: F.length(x) > 3)
    return with_start.withColumns(
        {
            "document_title": F.get(lines, F.lit(0)),
            "segmentable": F.when(
                F.col("_start").isNotNull(), F.substring(text, F.col("_start"), F.length(text))
            ).otherwise(text),
        }
    ).drop("_start")


def word_chunks(documents: DataFrame, n: int = lex.WINDOW_WORDS) -> DataFrame:
    """Fixed windows of n words, titled "Section k"."""
    with_words = documents.select("doc_id", words_of(F.col("text")).alias("_w")).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(1), F.size("_w"), F.lit(n))
    chunks = F.transform(starts, lambda at: F.array_join(F.slice(F.col("_w"), at, F.lit(n)), " "))
    rows = with_words.select("doc_id", F.posexplode(chunks).alias("pos", "text"))
    return rows.select(
        "doc_id",
        (F.col("pos") + 1).alias("chunk_no"),
        F.concat(F.lit("Section "), (F.col("pos") + 1).cast("string")).alias("title"),
        "text",
    )


def pages_of(documents: DataFrame) -> DataFrame:
    """One row per physical page, blank ones included, numbered from 1."""
    rows = documents.select("doc_id", F.posexplode(F.split("file_text", "\f")).alias("pos", "page"))
    return rows.select("doc_id", (F.col("pos") + 1).cast("int").alias("page_no"), clean_text(F.col("page")).alias("text"))


def assemble_full_text(pages: DataFrame) -> DataFrame:
    """S3: non-blank pages in order, separated by a blank line; every document, whatever its size."""
    page = F.when(strip(F.col("text")) != "", F.struct("page_no", "text"))
    gathered = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("_p"))
    return gathered.select("doc_id", F.array_join(F.col("_p.text"), "\n\n").alias("text"))
