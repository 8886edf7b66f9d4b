"""Citation markers in chat text: extraction, validation and removal (X10 and the scalars behind K1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pactscope.functions.lexicon import CITATION
from pactscope.functions.text import strip


def cited_ids(text: Column) -> Column:
    """All cited ids, with repeats, in order."""
    return F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))


def valid_citations(text: Column, allowed: Column) -> Column:
    """Cited ids that are allowed, once each, in order of first citation."""
    return F.array_intersect(cited_ids(text), allowed)


def remove_markers(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def strip_citations(text: Column) -> Column:
    """Markers removed, runs of blanks squeezed, no blank before punctuation, trimmed."""
    squeezed = F.regexp_replace(remove_markers(text), r"[ \t]{2,}", " ")
    return strip(F.regexp_replace(squeezed, r" +([.,;!?])", "$1"))


def visible_text(text: Column) -> Column:
    """What a reader of the filtered stream has seen at its end: no markers and no cut-off marker."""
    whole = remove_markers(text)
    return F.regexp_replace(F.regexp_replace(whole, r"\[CITE:[^\]]*\z", ""), r"\[CITE?\z", "")
