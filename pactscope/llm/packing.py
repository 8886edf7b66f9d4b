"""Best-fit packing into sequences of several permitted lengths.

Documents longer than the largest length give full sequences of their own and a rest. All other pieces are packed in
decreasing order: a piece goes to the open bin that it fills best; where none has room, a bin is opened. Which size to open is
chosen over all permitted lengths jointly: one plan per length opens no smaller bins than that, one more plan opens the size
with the least cost per token it can expect to hold, and the plan with the least cost of all bins is taken. Before costs are
compared every bin is cut down to the smallest permitted length that holds its contents.

A bin of length c costs BIN + c + c^2 / SQUARE: a part for each sequence, a linear and a quadratic one (attention).

Each task packs the rows it reads, up to GROUP pieces at a time: no shuffle, memory bounded by GROUP numbers, no key can be
hot. Bins never mix tasks; what that costs is a few bins per task, which are cut down like all others. Bin ids hold the task
number in front, so a task that runs again gives the same ids.

Edge cases: a null or empty text has no words and takes the one place of its end mark. Rows that repeat an id are packed each.
Null ids stay null. An empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Permitted lengths, cost of a sequence, divisor of the quadratic cost, pieces packed together.
LENGTHS, BIN, SQUARE, GROUP = (256, 512, 1024, 2048, 4096), 16.0, 65_536.0, 50_000


def cost(length):
    return BIN + length + length * length / SQUARE


def word_length(column: str = "text") -> Column:
    """Words of the whole text, and one place for the end mark."""
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def _opened(length: int, rest: int, lengths: list[int], plan: int | None) -> int:
    """The size to open for a piece; rest: the tokens that are still to be packed after it."""
    fits = [c for c in lengths if c >= length]
    if plan is not None:
        return next((c for c in fits if c >= plan), fits[-1])
    return min(fits, key=lambda c: (cost(c) / min(c, length + rest), -c))


def best_fit(pieces: list[int], lengths: list[int], plan: int | None) -> tuple[list[int], list[int]]:
    """The bin of each piece (decreasing lengths), and the contents of each bin."""
    rooms: list[int] = []  # different free spaces of open bins, in order
    having: dict[int, list[int]] = {}
    bins, contents, rest = [], [], sum(pieces)
    for piece in pieces:
        rest -= piece
        at = bisect_left(rooms, piece)
        if at < len(rooms):
            room = rooms[at]
            chosen = having[room].pop()
            if not having[room]:
                del having[room]
                rooms.pop(at)
        else:
            room, chosen = _opened(piece, rest, lengths, plan), len(contents)
            contents.append(0)
        bins.append(chosen)
        contents[chosen] += piece
        room -= piece
        if room:
            if room not in having:
                having[room] = []
                insort(rooms, room)
            having[room].append(chosen)
    return bins, contents


def packed(pieces: list[int], lengths: list[int]) -> tuple[list[int], list[int]]:
    """The bin of each piece (decreasing lengths) and the final length of each bin, by the cheapest plan."""
    best = None
    for plan in [*lengths, None]:
        bins, contents = best_fit(pieces, lengths, plan)
        sizes = [lengths[bisect_left(lengths, c)] for c in contents]
        total = sum(map(cost, sizes))
        if best is None or total < best[0]:
            best = total, bins, sizes
    return best[1], best[2]


def _packing(lengths: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_bin, waiting, many = TaskContext.get().partitionId() << 33, [], 0

        def flushed():
            nonlocal first_bin
            rows = pa.Table.from_batches(waiting)
            length = rows["length"].to_numpy()
            order = np.argsort(-length, kind="stable")
            bins, sizes = packed(length[order].tolist(), lengths)
            bins = np.array(bins, np.int64)
            by_bin = np.argsort(bins, kind="stable")
            taken = length[order][by_bin]
            ends = np.cumsum(taken)
            new = np.r_[True, bins[by_bin][1:] != bins[by_bin][:-1]]
            begin = np.maximum.accumulate(np.where(new, ends - taken, 0))
            rows = rows.take(pa.array(order[by_bin]))
            rows = rows.append_column("bin_id", pa.array(bins[by_bin] + first_bin))
            rows = rows.append_column("bin_size", pa.array(np.array(sizes, np.int64)[bins[by_bin]]))
            first_bin += len(sizes)
            return rows.append_column("bin_offset", pa.array(ends - taken - begin)).to_batches()

        for batch in batches:
            waiting.append(batch)
            many += batch.num_rows
            if many >= GROUP:
                yield from flushed()
                waiting, many = [], 0
        if many:
            yield from flushed()

    return run


def pack(docs: DataFrame, length: Column | None = None, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """One row per piece of a document: doc_id, piece, offset, length, bin_id, bin_size, bin_offset.

    Offset and length say which tokens of the document; bin_offset says where they stand in their sequence.
    """
    permitted = sorted(lengths)
    top = permitted[-1]
    rows = docs.select("doc_id", (word_length() if length is None else length).cast("long").alias("tokens"))
    rows = rows.filter("tokens > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.ceil(F.col("tokens") / top).cast("int") - 1)))
    offset = F.col("piece").cast("long") * top
    pieces = rows.select("doc_id", "piece", offset.alias("offset"), F.least(F.lit(top), F.col("tokens") - offset).alias("length"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, offset long, length long, bin_id long, bin_size long, bin_offset long"
    return pieces.mapInArrow(_packing(permitted), schema)
