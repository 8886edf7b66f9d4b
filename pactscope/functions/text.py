"""Column builders for text: matching, trimming, counting and slicing.

All offsets handed out are 0-based and end-exclusive. Patterns run with
UNIX line ends and Unicode character classes, on lower-cased text unless a
caller says otherwise.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactscope.functions.lexicon import GUARDS, INITIALS, PATTERNS, WORDS, WS_CHARS

JAVA_FLAGS = "(?dU)"

#: ``lexicon.SPACE`` for Java: a letter is told from white space by three comparisons instead of one per range.
SPACES = (
    r"[\x1c-\x20\t-\r[\x{85}-\x{3000}&&"
    r"[\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]+"
)


def sql_literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _column(text: Column | str) -> Column:
    return F.col(text) if isinstance(text, str) else text


def matches(text: Column | str, pattern: str, flags: str = "") -> Column:
    """Unanchored search for ``pattern``; extra inline ``flags`` such as "m" or "i".

    A look at the next letter comes first where it can rule a place out: a Unicode word boundary takes far longer.
    """
    if not flags and pattern in INITIALS:
        pattern = f"(?={INITIALS[pattern]})" + pattern
    return _column(text).rlike(f"(?dU{flags})" + pattern)


def has_pattern(text: Column | str, name: str) -> Column:
    """Named pattern; a cheap containment test spares most texts the pattern itself."""
    guard = GUARDS.get(name)
    return contains_any(text, guard) & matches(text, PATTERNS[name]) if guard else matches(text, PATTERNS[name])


def contains_any(text: Column | str, words: list[str]) -> Column:
    """Whether any word occurs; given a column by name, the whole test is built in one call."""
    if isinstance(text, str):
        return F.expr(" OR ".join(f"contains(`{text}`, {sql_literal(w)})" for w in words))
    return reduce(or_, [F.contains(text, F.lit(w)) for w in words])


def has_words(text: Column | str, name: str) -> Column:
    return contains_any(text, WORDS[name])


def count_words_present(text: Column, words: list[str]) -> Column:
    """How many of ``words`` occur in ``text`` (each counted once)."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def strip_of(text: Column, chars: str) -> Column:
    """Trim the given characters."""
    return F.btrim(text, F.lit(chars))


def spaced(text: Column) -> Column:
    """Every white-space character as a blank; matching the characters between them takes ten times as long."""
    return F.translate(text, WS_CHARS, " " * len(WS_CHARS))


def word_count(text: Column) -> Column:
    return F.size(words_of(text))


def has_more_words_than(text: Column, n: int) -> Column:
    """Whether a stripped text has more than ``n`` words (n > 0); no more than that are split off."""
    return F.size(F.split(spaced(text), " +", n + 1)) > n


def words_of(text: Column) -> Column:
    """White-space separated words, without empty strings."""
    return F.filter(F.split(spaced(text), " "), lambda w: w != "")


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one blank (ends are kept)."""
    return F.regexp_replace(text, SPACES, " ")


def normalize_ws(text: Column) -> Column:
    return F.lower(squeeze(text))


def escape_pattern(text: Column) -> Column:
    """Quote ``text`` for use inside a pattern."""
    return F.regexp_replace(text, r"([\\.\[\]{}()*+?^$|\-])", r"\\$1")


def sub(text: Column, pattern: str, replacement: str, flags: str = "") -> Column:
    return F.regexp_replace(text, f"(?dU{flags})" + pattern, replacement)


def first_group(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    """Group of the first match, null instead of an empty string."""
    return F.nullif(F.regexp_extract(text, f"(?dU{flags})" + pattern, group), F.lit(""))


def all_groups(text: Column, pattern: str, group: int = 1, flags: str = "") -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?dU{flags})" + pattern), F.lit(group))


def find(text: Column, needle: Column) -> Column:
    """0-based position, -1 when absent."""
    return F.call_function("instr", text, needle) - 1


def cut(text: Column, start: Column, length: Column) -> Column:
    """Substring at a 0-based start."""
    return F.substring(text, start + 1, length)


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def first_present(*columns: Column) -> Column:
    """First value that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(c) for c in columns])


def flag(condition: Column) -> Column:
    """Boolean as 0/1 BIGINT, unknown counted as 0."""
    return F.coalesce(condition, F.lit(False)).cast("bigint")


def spread(df: DataFrame, keys: list, array: Column, position: str, item: str) -> DataFrame:
    """One row per array element with its 0-based position.

    The outer form plus a filter on the position keeps the optimizer from repeating the array's whole
    expression in a filter of its own below the explode.
    """
    return df.select(*keys, F.posexplode_outer(array).alias(position, item)).where(F.col(position).isNotNull())


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def apart(value: Column) -> Column:
    """The same value, by way of a list of one.

    Spark keeps a projection with such a list out of whole-stage code and builds its other columns from small methods.
    Some hundred tests for words in one method make it larger than the JVM compiles (8,000 bytes), and it is then
    interpreted row by row.
    """
    return let(value, lambda x: x)
