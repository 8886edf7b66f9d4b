"""Where clauses lie on their pages (P4-P10, X7, X8) and to which page they belong."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.functions import anchors
from pactscope.functions import lexicon as lex
from pactscope.functions.walks import kept_positions, pages_in_order
from pactscope.functions.text import (
    SPACES,
    contains_any,
    escape_pattern,
    find,
    let,
    normalize_ws,
    strip,
    sub,
    words_of,
)

SPAN = "struct<start:int,end:int>"


def _span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def find_offsets(clause: Column, page: Column) -> Column:
    """Span of the exact text, else of the text up to case and white space, else null."""
    spaced = F.regexp_replace(escape_pattern(F.lower(clause)), SPACES, SPACES.replace("\\", "\\\\"))
    found = F.nullif(F.regexp_substr(F.lower(page), F.concat(F.lit("(?d)"), spaced)), F.lit(""))
    exact = let(find(page, clause), lambda at: F.when(at >= 0, _span(at, at + F.length(clause))))
    loose = let(
        found, lambda hit: F.when(hit.isNotNull(), let(find(F.lower(page), hit), lambda at: _span(at, at + F.length(hit))))
    )
    present = (F.coalesce(clause, F.lit("")) != "") & (F.coalesce(page, F.lit("")) != "")
    return F.when(present, F.coalesce(exact, loose))


def validate_offsets(start: Column, end: Column, page: Column, clause: Column) -> Column:
    """P5: offsets are in range and their slice equals the clause up to case and white space."""
    piece = strip(normalize_ws(F.substring(page, start + 1, end - start)))
    wanted = strip(normalize_ws(clause))
    inside = start.isNotNull() & end.isNotNull() & (start >= 0) & (end > start) & (end <= F.length(page))
    return F.coalesce(inside & (piece != "") & (piece == wanted), F.lit(False))


def safe_unique_span(page: Column, clause: Column) -> Column:
    """Span of a clause of at least 15 characters that occurs exactly once on the page."""

    def unique(v: Column) -> Column:
        again = find(F.substring(v["page"], v["at"] + 2, F.length(v["page"])), v["text"])
        return (F.length(v["text"]) >= 15) & (F.length(v["page"]) >= 15) & (v["at"] >= 0) & (again < 0)

    flat = F.struct(normalize_ws(page).alias("page"), strip(normalize_ws(clause)).alias("text"))
    placed = let(flat, lambda v: F.struct(v["page"].alias("page"), v["text"].alias("text"), find(v["page"], v["text"]).alias("at")))
    return F.when(let(placed, unique), find_offsets(strip(clause), page))


def resolve_highlight_span(start: Column, end: Column, page: Column, clause: Column) -> Column:
    """The given offsets when valid, else the unique match, else null."""
    return F.when(validate_offsets(start, end, page, clause), _span(start, end)).otherwise(
        safe_unique_span(page, clause)
    )


def highlightable(selected: Column | None = None) -> Column:
    """A risk issue, or the clause selected."""
    chosen = F.lit(False) if selected is None else F.coalesce(selected, F.lit(False))
    return (
        F.coalesce(F.col("is_risk_bearing"), F.lit(True))
        & (F.col("risk_level") != "NEUTRAL")
        & (F.col("risk_level").isin("HIGH", "MEDIUM") | (F.coalesce("unfairness", F.lit(0)) >= 50) | chosen)
    )


def non_overlapping_spans(spans: DataFrame) -> DataFrame:
    """Per page, spans by start (then clause), dropping one that starts before the last kept end.

    Only offsets are gathered, at most one span per clause of a page.
    """
    entry = F.struct("start", F.col("idx"), F.col("end"))
    listed = spans.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(entry)).alias("_s"))
    kept = F.explode(kept_positions(F.col("_s.start"), F.col("_s.end")))
    rows = listed.select("doc_id", "page_no", "_s", kept.alias("_at"))
    return rows.select("doc_id", "page_no", F.get("_s", F.col("_at")).alias("_k")).select("doc_id", "page_no", "_k.idx", "_k.start", "_k.end")


def page_text_or_rebuilt(clauses: DataFrame, pages: DataFrame) -> DataFrame:
    """The text of each clause page, rebuilt from its clauses where the page has none."""
    shown = F.when(
        F.coalesce("title", F.lit("")) != "", F.concat_ws("\n", F.col("title"), F.col("text"))
    ).otherwise(F.col("text"))
    rebuilt = (
        clauses.select("doc_id", F.coalesce("page_no", F.lit(1)).alias("page_no"), F.struct("idx", shown.alias("t")).alias("c"))
        .groupBy("doc_id", "page_no")
        .agg(F.array_join(F.array_sort(F.collect_list("c"))["t"], "\n\n").alias("_rebuilt"))
    )
    both = pages.select("doc_id", "page_no", "text").join(rebuilt.hint("merge"), ["doc_id", "page_no"], "full")
    return both.select(
        "doc_id", "page_no", F.coalesce(F.nullif("text", F.lit("")), "_rebuilt", F.lit("")).alias("text")
    )


# -- G8, X7: texts and the pages that hold them ------------------------------
_TESTS = {
    "raw": F.contains,
    "flat": lambda page, pattern: F.contains(normalize_ws(page), pattern),
    "low": lambda page, pattern: F.contains(F.lower(page), pattern),
}


def pages_holding(patterns: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Patterns (doc_id, keys, pattern, test) with ``found``: one row per page of the document that holds the pattern, and
    at least one row per pattern, ``found`` null where there is no page.

    Patterns meet pages by an anchor of their text (see ``functions.anchors``) and only then are compared. Pages are
    indexed by what their document needs: long anchors, short ones where it has short patterns, and as a whole where it
    has patterns too short for any anchor.

    The joins are merges: the optimizer guesses sizes by the columns of the scan, sees nothing of the texts built from
    them, and would send the pages through the driver.
    """
    form = anchors.plain(F.col("pattern"))
    size = F.octet_length("_plain")
    wanted = patterns.withColumn("_plain", form).withColumn(
        "_kind", F.when(size.isNull(), -1).when(size >= anchors.least_bytes(anchors.LONG), 0).when(size >= anchors.least_bytes(anchors.SHORT), 1).otherwise(2)
    )
    by_kind = [
        anchors.pattern_anchor(F.when(F.col("_kind") == i, F.col("_plain")), kind) for i, kind in enumerate((anchors.LONG, anchors.SHORT))
    ]
    wanted = wanted.withColumn("_anchor", F.coalesce(*by_kind, F.lit(0).cast("bigint"))).drop("_plain")

    needs = wanted.where("_kind >= 0").groupBy("doc_id").agg(*[F.max(F.col("_kind") == k).alias(f"_has_{k}") for k in range(3)])
    texts = pages.select("doc_id", F.col("page_no").alias("_page"), F.col("text").alias("_page_text"))
    told = texts.join(needs.hint("merge"), "doc_id").withColumn("_plain", anchors.plain(F.col("_page_text")))
    indexed = told.select(
        "doc_id", "_page",
        F.array(
            F.struct(F.lit(0).alias("_kind"), anchors.page_anchors(F.when(F.col("_has_0"), F.col("_plain")), anchors.LONG).alias("a")),
            F.struct(F.lit(1).alias("_kind"), anchors.page_anchors(F.when(F.col("_has_1"), F.col("_plain")), anchors.SHORT).alias("a")),
            F.struct(F.lit(2).alias("_kind"), F.when(F.col("_has_2"), F.array(F.lit(0).cast("bigint"))).alias("a")),
        ).alias("_i"),
    )
    index = indexed.select("doc_id", "_page", F.inline("_i")).select("doc_id", "_page", "_kind", F.explode("a").alias("_anchor"))

    met = wanted.join(index.hint("merge"), ["doc_id", "_kind", "_anchor"], "left").drop("_kind", "_anchor")
    both = met.join(texts.hint("merge"), ["doc_id", "_page"], "left")
    holds = F.lit(False)
    for name, test in _TESTS.items():
        holds = F.when(F.col("test") == name, test(F.col("_page_text"), F.col("pattern"))).otherwise(holds)
    return both.select("doc_id", *keys, F.when(holds, F.col("_page")).alias("found"))


def containing_page(clauses: DataFrame, pages: DataFrame) -> DataFrame:
    """First page of the document that holds the clause text, null when none does."""
    patterns = clauses.select("doc_id", "idx", F.col("text").alias("pattern"), F.lit("raw").alias("test"))
    return pages_holding(patterns, pages, ["idx"]).groupBy("doc_id", "idx").agg(F.min("found").alias("found_page"))


def _page_patterns() -> tuple[Column, Column]:
    """What G8 looks for on pages: (tier, pattern, test) of the text, its beginning and its first lines; and the title."""
    head = normalize_ws(F.substring("text", 1, 140))
    lines = F.filter(
        F.transform(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"), strip), lambda x: F.length(x) > 18
    )
    telling = F.filter(F.slice(lines, 1, 3), lambda x: ~contains_any(F.upper(x), lex.RUNNING_HEADER_WORDS))

    def pattern(tier: Column, text: Column, test: str) -> Column:
        return F.struct(tier.cast("int").alias("tier"), text.alias("pattern"), F.lit(test).alias("test"))

    body = F.concat(
        F.array(pattern(F.lit(0), F.col("text"), "raw"), pattern(F.lit(1), F.when(F.length(head) > 15, head), "flat")),
        F.coalesce(
            F.transform(telling, lambda x, i: pattern(i + 2, F.substring(x, 1, 50), "raw")),
            F.array().cast("array<struct<tier:int,pattern:string,test:string>>"),
        ),
    )
    title = F.lower(strip(sub(F.col("title"), lex.TITLE_PREFIX, "", flags="i")))
    return body, F.when((F.length(title) > 8) & ~title.isin(lex.GENERIC_TITLES), title)


def attribute_pages(
    clauses: DataFrame, pages: DataFrame, kept: Callable[[DataFrame, str], DataFrame] = lambda rows, name: rows
) -> DataFrame:
    """Page of each clause: exact text, then its beginning from the current page on, then its first lines,
    then a distinctive title, else the page of the clause before.

    Texts and pages meet in joins by anchors; titles only where nothing else of a clause was found. The choice depends on
    the clause before, so numbers of a contract's clauses are walked through in order at the end. ``kept`` may give what the
    first join found, which the second one uses twice, back from a table.
    """
    body, title = _page_patterns()
    looked_for = clauses.select("doc_id", "idx", title.alias("_title"), F.inline(body))
    seen = pages_holding(looked_for.where((F.col("tier") == 0) | F.col("pattern").isNotNull()), pages, ["idx", "tier", "_title"])

    def first(tier: int) -> Column:
        return F.min(F.when(F.col("tier") == tier, F.col("found")))

    tiers = seen.groupBy("doc_id", "idx").agg(
        first(0).alias("exact"), F.sort_array(F.collect_set(F.when(F.col("tier") == 1, F.col("found")))).alias("starts"),
        F.coalesce(*[first(t) for t in (2, 3, 4)]).alias("by_line"), F.max("_title").alias("pattern"),
    )
    tiers = kept(tiers, "tiers")
    unseen = F.col("exact").isNull() & (F.size("starts") == 0) & F.col("by_line").isNull()
    titled = tiers.withColumn("pattern", F.when(unseen, F.col("pattern"))).withColumn("test", F.lit("low"))
    found = pages_holding(titled, pages, ["idx", "exact", "starts", "by_line"])
    each = found.groupBy("doc_id", "idx", "exact", "starts").agg(F.coalesce(F.min("by_line"), F.min("found")).alias("late"))
    listed = each.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("idx", "exact", "starts", "late"))).alias("_c"))
    chosen = pages_in_order(F.col("_c.exact"), F.col("_c.starts"), F.col("_c.late"))
    return listed.select("doc_id", F.inline(F.arrays_zip(F.col("_c.idx").alias("idx"), chosen.alias("page_no"))))
