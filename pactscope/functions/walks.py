"""Greedy walks over the items of one contract or page.

Where a window, a batch or a span ends decides where the next one can begin, so a walk
goes in order. It only looks at lists of numbers: prefix sums or sorted starts, in which
the next beginning is found by binary search. Texts stay where they are. A walk takes as
many searches as it has steps, in Arrow batches of lists.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf


def next_fit(sizes: list[int], limit: int) -> list[int]:
    """Positions at which a new group begins, when items fill groups of at most ``limit`` in order.

    An item that is larger than that has a group of its own.
    """
    sums, begins, at = list(accumulate(sizes)), [], 0
    while at < len(sizes):
        begins.append(at)
        used = sums[at - 1] if at else 0
        at = max(at + 1, bisect_right(sums, used + limit, at))
    return begins


def compatible(starts: list[int], ends: list[int]) -> list[int]:
    """Positions kept of spans in order of their starts, when one that starts before the last kept end goes."""
    kept, at, last = [], 0, 0
    while (at := bisect_left(starts, last, at)) < len(starts):
        kept.append(at)
        last = ends[at]
        at += 1
    return kept


def following(exact: list, starts: list, late: list) -> list[int]:
    """Pages of clauses in order: the exact one, else the first of ``starts`` (sorted) from the page before on, else the
    first of them, else the late one, else the page before."""
    pages, page = [], 1
    for one, several, other in zip(exact, starts, late, strict=True):
        if one is not None:
            page = one
        elif several:
            at = bisect_left(several, page)
            page = several[at] if at < len(several) else several[0]
        elif other is not None:
            page = other
        pages.append(page)
    return pages


def _lists(walk, *columns: pa.Array) -> pa.Array:
    rows = zip(*(c.to_pylist() for c in columns), strict=True)
    return pa.array([None if row[0] is None else walk(*row) for row in rows], pa.list_(pa.int32()))


def group_begins(sizes: Column, limit: int) -> Column:
    """``next_fit`` over a list of sizes: 0-based positions."""

    @arrow_udf("array<int>")
    def run(sizes: pa.Array) -> pa.Array:
        return _lists(lambda row: next_fit(row, limit), sizes)

    return run(sizes)


def kept_positions(starts: Column, ends: Column) -> Column:
    """``compatible`` over lists of starts (sorted) and ends: 0-based positions."""

    @arrow_udf("array<int>")
    def run(starts: pa.Array, ends: pa.Array) -> pa.Array:
        return _lists(compatible, starts, ends)

    return run(starts, ends)


def pages_in_order(exact: Column, starts: Column, late: Column) -> Column:
    """``following`` over the clauses of a contract, one page each."""

    @arrow_udf("array<int>")
    def run(exact: pa.Array, starts: pa.Array, late: pa.Array) -> pa.Array:
        return _lists(following, exact, starts, late)

    return run(exact, starts, late)
