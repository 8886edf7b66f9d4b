"""Segmentation of document texts into clauses.

A document is one row, so all of this is a narrow projection over arrays inside
that row, followed by one explode; nothing is shuffled. A row is bounded by the
admission limit for files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.functions import lexicon as lex
from pactscope.functions.walks import group_begins
from pactscope.functions.text import (
    contains_any,
    let,
    matches,
    spread,
    squeeze,
    strip,
    strip_of,
    sub,
    word_count,
    words_of,
)
from pactscope.operators.prepare import with_title_block

# Two code points that Unicode reserves for use inside a program; text that holds them all the same gets U+FFFD there.
MARK, END = "\ufdd0", "\ufdd1"
EDGE = " :.-"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"


# -- G1 ---------------------------------------------------------------------
def _marked(text: Column, pattern: str) -> Column:
    """Parts of ``text`` that start with a match; what precedes the first match is dropped."""
    text = F.translate(text, MARK + END, "\ufffd\ufffd")
    marked = F.regexp_replace(text, f"(?dm)({pattern})", MARK + "$1" + END)
    return let(F.split(marked, MARK), lambda parts: F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))))


def section_chunks(text: Column) -> Column:
    """G1: array<struct<title, text>> of the numbered or capitalised sections of a text.

    Dropped: headings in the first 300 characters that are neither numbered nor preceded by a numbered one,
    running headers, and bodies of at most 30 characters.
    """
    found = F.transform(
        _marked(text, lex.SECTION_HEADING),
        lambda part: F.struct(
            strip(F.split_part(part, F.lit(END), F.lit(1))).alias("head"),
            F.replace(part, F.lit(END), F.lit("")).alias("body"),
        ),
    )
    return let(found, lambda f: _kept_sections(text, f))


def _kept_sections(text: Column, found: Column) -> Column:
    numbered = F.transform(found, lambda c: matches(F.lower(c["head"]), lex.NUMBERED_HEADING))
    lead = F.length(text) - F.aggregate(found, F.lit(0), lambda acc, c: acc + F.length(c["body"]))
    # starts grow, so the headings that start before position 300 are the first ones
    early = F.aggregate(
        found,
        F.struct(lead.cast("int").alias("next"), F.lit(0).alias("n")),
        lambda acc, c: F.struct(
            (acc["next"] + F.length(c["body"])).alias("next"), (acc["n"] + (acc["next"] < 300).cast("int")).alias("n")
        ),
    )["n"]

    def keep(facts: Column) -> Column:
        rows = F.transform(
            found,
            lambda c, i: F.struct(
                strip_of(squeeze(c["head"]), EDGE).alias("title"),
                strip(c["body"]).alias("text"),
                (
                    (i < facts["early"])
                    & ((facts["first"] == 0) | (facts["first"] > i + 1))
                ).alias("noise"),
            ),
        )
        kept = F.filter(
            rows,
            lambda c: ~c["noise"]
            & ~contains_any(F.upper(c["title"]), lex.HEADING_NOISE_WORDS)
            & (F.length(c["text"]) > 30),
        )
        return F.transform(kept, lambda c: F.struct(c["title"].alias("title"), c["text"].alias("text")))

    facts = F.struct(early.alias("early"), F.array_position(numbered, True).alias("first"))
    return let(facts, keep)


# -- G2 ---------------------------------------------------------------------
def paragraph_windows(text: Column, target: int = lex.WINDOW_WORDS) -> Column:
    """array<struct<title, text>>; paragraphs packed in order into windows of at most ``target`` words."""
    paragraphs = F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")
    begins = group_begins(F.transform(paragraphs, word_count), target)

    def window(ps: Column, bs: Column, at: Column, i: Column) -> Column:
        members = F.slice(ps, at + 1, F.coalesce(F.get(bs, i + 1), F.size(ps)) - at)
        line = strip(F.substring(F.split_part(F.get(ps, at), F.lit("\n"), F.lit(1)), 1, 60))
        title = F.when(F.length(line) > 5, line).otherwise(F.concat(F.lit("Section "), (i + 1).cast("string")))
        return F.struct(title.alias("title"), F.array_join(members, "\n\n").alias("text"))

    return let(
        F.struct(paragraphs.alias("p"), begins.alias("b")),
        lambda v: F.transform(v["b"], lambda at, i: window(v["p"], v["b"], at, i)),
    )


# -- G3 ---------------------------------------------------------------------
def segment_or_window(documents: DataFrame, text: str = "segmentable") -> DataFrame:
    """Adds ``sections``; paragraph windows where fewer than three sections were found."""
    found = documents.withColumn("_found", section_chunks(F.col(text)))
    unsectioned = F.when(F.size("_found") < 3, F.col(text))
    return found.withColumn("sections", F.coalesce(paragraph_windows(unsectioned), "_found")).drop("_found")


# -- G6 ---------------------------------------------------------------------
def subclause_name(first_line: Column, number: Column) -> Column:
    """A short name from the first line of a sub-clause, empty when there is none."""
    after = F.when(
        F.startswith(first_line, number), F.substring(first_line, F.length(number) + 1, F.length(first_line))
    ).otherwise(first_line)
    return let(strip(after), _name_in)


def _name_in(rest: Column) -> Column:
    quoted = F.regexp_extract(rest, r"""^["']([^"']+)["']""", 1)

    def before(delimiter: str, max_chars: int, max_words: int) -> Column:
        head = strip(F.split_part(rest, F.lit(delimiter), F.lit(1)))
        fits = lambda h: F.when((F.length(h) < max_chars) & (word_count(h) <= max_words), h)
        return F.when(F.contains(rest, F.lit(delimiter)), let(head, fits))

    dash = contains_any(rest, ["—", " - "])
    trailing = matches(F.lower(rest), r"(?: means| shall| will| is)\z")
    five = F.array_join(F.slice(words_of(rest), 1, 5), " ")
    return F.when(rest == "", "").otherwise(
        F.coalesce(
            F.when(quoted != "", F.concat(F.lit('"'), quoted, F.lit('"'))),
            F.when(dash & (F.length(rest) <= 60) & ~trailing, strip_of(rest, " .:-")),
            before(":", 50, 6),
            before(".", 50, 6),
            before(" — ", 60, 8),
            before("—", 60, 8),
            before(" - ", 60, 8),
            let(five, lambda f: F.when(F.length(f) < 40, f)),
            F.lit(""),
        )
    )


# -- G5 ---------------------------------------------------------------------
def title_case(text: Column) -> Column:
    """Upper case after every non-letter, lower case elsewhere."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.initcap(p)), "")


def subclause_title(parent: Column, number: Column, name: Column) -> Column:
    """Number and name, with the parent heading or one of its topics where that adds something."""
    parent_low, name_low = F.lower(parent), F.lower(name)
    said = F.contains(name_low, parent_low) | F.exists(
        words_of(parent_low), lambda w: (F.length(w) > 4) & F.contains(name_low, w)
    )
    topics = F.filter(
        F.transform(F.split(parent, r"(?iU)\s+(?:and|&)\s+"), strip), lambda t: F.length(t) > 2
    )
    matching = F.filter(
        topics,
        lambda t: F.exists(words_of(F.lower(t)), lambda w: (F.length(w) > 3) & F.contains(name_low, w)),
    )
    topic = F.when(F.size(topics) > 1, F.get(matching, F.lit(0)))
    bare = F.concat(number, F.lit(" "), name)

    def under(prefix: Column) -> Column:
        return F.concat(number, F.lit(" "), prefix, F.lit(" — "), name)

    named = (
        F.when(said, bare)
        .when(
            F.contains(F.upper(parent), F.lit("DEFINITIONS")) & F.startswith(name, F.lit('"')),
            under(F.lit("Definitions")),
        )
        .when(parent == "", bare)
        .when(topic.isNotNull(), under(title_case(topic)))
        .when(F.length(parent) < 35, under(parent))
        .otherwise(bare)
    )
    unnamed = F.when(parent != "", F.concat(number, F.lit(" "), parent)).otherwise(F.concat(F.lit("Clause "), number))
    return F.when(name != "", named).otherwise(unnamed)


# -- G4 ---------------------------------------------------------------------
def _subclause(heading: Column, piece: Column) -> Column:
    number = F.regexp_extract(piece, lex.SUBCLAUSE_START, 1)
    first_line = strip(F.get(F.split(piece, LINE_END, 2), F.lit(0)))
    parent = strip_of(strip(sub(heading, lex.HEADING_PREFIX, "", flags="i")), EDGE)
    return let(
        F.struct(number.alias("number"), first_line.alias("line"), parent.alias("parent")),
        lambda v: let(
            subclause_name(v["line"], v["number"]),
            lambda name: F.struct(subclause_title(v["parent"], v["number"], name).alias("title"), piece.alias("text")),
        ),
    )


def subclauses(section: Column) -> Column:
    """array<struct<title, text>> of a section's sub-clauses; a section without any stands for itself.

    Pieces under 15 characters are dropped, and so is what precedes the first sub-number.
    """
    pieces = F.filter(
        F.transform(
            _marked(section["text"], lex.SUBCLAUSE_START.replace("(", "(?:", 1)),
            lambda p: strip(F.replace(p, F.lit(END), F.lit(""))),
        ),
        lambda p: F.length(p) >= 15,
    )
    return let(
        pieces,
        lambda ps: F.when(F.size(ps) == 0, F.array(F.struct(section["title"].alias("title"), section["text"].alias("text"))))
        .otherwise(F.transform(ps, lambda p: _subclause(section["title"], p))),
    )


def section_rows(documents: DataFrame) -> DataFrame:
    """Sections of every document as rows (doc_id, sec_no, title, text)."""
    return spread(documents, ["doc_id"], F.col("sections"), "_p", "_s").select(
        "doc_id", (F.col("_p") + 1).alias("sec_no"), "_s.title", "_s.text"
    )


def subclause_rows(documents: DataFrame) -> DataFrame:
    """Sub-clauses of every section as rows (doc_id, sec_no, sub_no, title, text)."""
    sections = spread(documents, ["doc_id"], F.col("sections"), "_p", "_s")
    rows = spread(sections, ["doc_id", "_p"], subclauses(F.col("_s")), "_q", "_c")
    return rows.select(
        "doc_id", (F.col("_p") + 1).alias("sec_no"), (F.col("_q") + 1).alias("sub_no"), "_c.title", "_c.text"
    )


# -- G7 ---------------------------------------------------------------------
def number_clauses(documents: DataFrame) -> DataFrame:
    """Documents (doc_id, text) to numbered clauses: P2, G3, G4-G6, then ids ``clause_1`` and so on."""
    sections = segment_or_window(with_title_block(documents))
    rows = spread(sections, ["doc_id"], F.flatten(F.transform("sections", subclauses)), "_p", "_c")
    idx = (F.col("_p") + 1).cast("int")
    return rows.select(
        "doc_id", idx.alias("idx"), F.concat(F.lit("clause_"), idx).alias("clause_id"), "_c.title", "_c.text"
    )
