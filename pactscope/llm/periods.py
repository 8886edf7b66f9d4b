"""Stretches of words that repeat with a period, by seeds that are extended on their diagonal.

A run is a stretch of consecutive words with smallest period q and a length of max(SHORTEST, REPEATS * q) or more that no
neighbouring word extends. On the diagonal of lag q (words compared with those q later) it is a row of equal words, at least
max(SHORTEST - q, 3 * q) of them.

1. Words are hashed and blocks of documents laid behind each other, so that numpy works on a few megabytes at a time; a
   longer document is a block of its own.
2. Lags fall into classes [Q, 1.5 Q]. A run of such a lag holds k-grams of k = 3 Q words, the overlap guaranteed to the
   shortest run of the class, at a distance of its period. The index of a class holds the places whose k-gram may occur twice
   in its document: all its grams of five words do, which is looked up once and leaves little of most texts.
3. Occurrences of a k-gram in the same document, one after the other, give pairs (place, lag). A k-gram has at least twice
   as many words as its class's longest lag, so inside a run of smallest period q its next occurrence is exactly q later:
   neighbours in the list suffice, pairs are linear in the words, and no run is missed.
4. A pair is a seed and is extended to both sides word by word, unless the table of the furthest word covered on its lag has
   it behind that word: each diagonal is walked once.
5. A stretch found at several lags keeps its smallest one.

No document needs another one, so rows stay where they are read and nothing is shuffled. Time grows with the words of a block
times the logarithm of its longest lag. Words are compared as 64-bit hashes: two different words of one document share one
with a probability below 10^-10.

Edge cases: a null text has no words; empty and blank texts neither. Rows that repeat a doc_id are judged each by its own
text, null ids too. An empty table gives an empty result. Columns that aren't named are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pactscope.llm import common
from pactscope.llm.common import text_bytes

#: Words of the shortest run, and repeats of the period that a run has at least.
SHORTEST, REPEATS = 6, 4
#: Bytes of text that are laid behind each other.
BLOCK_BYTES = 1 << 21

RUNS = "array<struct<start: long, length: long, period: long>>"


def lag_classes(longest: int) -> Iterator[tuple[int, int, int]]:
    """(least lag, greatest lag, k) up to a lag; k words are shared by every run of the class with itself, one lag later."""
    least = 1
    while least <= longest:
        overlap = max((REPEATS - 1) * least, SHORTEST - least)
        greatest = max(least, overlap // 2 if least > 1 else 1)
        yield least, min(greatest, longest), overlap
        least = greatest + 1


def _next_equal(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (rows in order) whose key comes again in the same document, and where it comes next."""
    order = np.argsort(keys, kind="stable")
    a, b = order[:-1], order[1:]
    same = (keys[a] == keys[b]) & (docs[a] == docs[b])
    return a[same], b[same]


def _extended(words: np.ndarray, at: int, lag: int, width: int, low: int, high: int) -> tuple[int, int]:
    """The widest [start, end) around width equal words at `at` in which words equal those `lag` later, inside [low, high)."""
    start, step = at, 16
    while start > low:
        begin = max(low, start - step)
        unlike = np.flatnonzero(words[begin:start] != words[begin + lag : start + lag])
        if len(unlike):
            start = begin + int(unlike[-1]) + 1
            break
        start, step = begin, 2 * step
    end, step = at + width, 16
    while end + lag < high:
        stop = min(high - lag, end + step)
        unlike = np.flatnonzero(words[end:stop] != words[end + lag : stop + lag])
        if len(unlike):
            end += int(unlike[0])
            break
        end, step = stop, 2 * step
    return start, end


def runs_of(words: np.ndarray, sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each document, by start and period; words: hashes, sizes: words of each document."""
    found: list[dict[tuple[int, int], int]] = [{} for _ in sizes]
    begins = np.r_[0, np.cumsum(sizes)]
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = begins[1:][doc]
    sums = common.prefix_hashes(words)
    least = SHORTEST - 1
    places = np.flatnonzero(np.arange(len(words)) + least <= ends)
    a, b = _next_equal(common.span_hashes(sums, places, places + least), doc[places])
    again = np.zeros(len(words) + 1, bool)
    again[places[a]] = again[places[b]] = True
    # How many places in a row, from each one on, hold a gram that occurs twice.
    breaks = np.flatnonzero(~again)
    row = breaks[np.searchsorted(breaks, np.arange(len(words)))] - np.arange(len(words))
    for low, high, k in lag_classes(int(max(sizes, default=0)) // REPEATS):
        places = np.flatnonzero(row >= k - least + 1)
        places = places[places + k <= ends[places]]
        if not len(places):
            break
        a, b = _next_equal(common.span_hashes(sums, places, places + k), doc[places])
        at, lag = places[a], places[b] - places[a]
        fits = (lag >= low) & (lag <= high)
        order = np.lexsort((at[fits], lag[fits]))
        at, lag = at[fits][order], lag[fits][order]
        # A seed right behind another one of its lag is covered by that one's extension.
        heads = np.r_[True, (lag[1:] != lag[:-1]) | (at[1:] != at[:-1] + 1)][: len(at)]
        covered: dict[int, int] = {}
        for i, q in zip(at[heads].tolist(), lag[heads].tolist(), strict=True):
            if i < covered.get(q, 0):
                continue
            d = int(doc[i])
            start, end = _extended(words, i, q, k, int(begins[d]), int(begins[d + 1]))
            covered[q] = end
            length = end + q - start
            if length >= max(SHORTEST, REPEATS * q):
                found[d].setdefault((start - int(begins[d]), length), q)
    return [sorted((s, n, q) for (s, n), q in runs.items()) for runs in found]


def _kept(spans: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """The words that no run repeats: those outside of runs, and the first period of each unless another run repeats it."""
    turns = np.zeros(n + 1, np.int64)
    for start, length, period in spans:
        turns[start + period] += 1
        turns[start + length] -= 1
    return np.flatnonzero(np.cumsum(turns[:n]) == 0)


def _collapsed(text: bytes, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> bytes:
    return b" ".join([text[a:b] for a, b in zip(starts[kept].tolist(), ends[kept].tolist(), strict=True)])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about BLOCK_BYTES of text."""
    for batch in batches:
        filled = np.cumsum(pc.binary_length(batch["data"]).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK_BYTES
        edges = [*np.flatnonzero(np.diff(filled, prepend=-1)).tolist(), batch.num_rows]
        yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]))


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _blocks(batches):
        texts = [x.as_py() for x in batch["data"]]
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        starts, ends = common.word_spans(data)
        words = common.span_hashes(common.byte_hashes(data), starts, ends)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
        first = np.searchsorted(starts, begins)
        runs = runs_of(words, np.diff(first))
        collapsed = []
        for text, at, a, b, spans in zip(texts, begins.tolist(), first[:-1], first[1:], runs, strict=False):
            collapsed.append(_collapsed(text, starts[a:b] - at, ends[a:b] - at, _kept(spans, b - a)))
        flat = [span for spans in runs for span in spans]
        columns = [pa.array([s[k] for s in flat], pa.int64()) for k in range(3)]
        lists = pa.ListArray.from_arrays(
            pa.array(np.cumsum([0, *map(len, runs)]), pa.int32()),
            pa.StructArray.from_arrays(columns, names=["start", "length", "period"]),
        )
        out = [batch["doc_id"], pa.array(np.diff(first), pa.int64()), lists, pa.array(collapsed, pa.binary()).view(pa.string())]
        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_words, runs (by start, then period), collapsed.

    collapsed: the text's words joined by one blank, without those that a run holds after its first period.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_bytes().alias("data"))
    return texts.mapInArrow(_found, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")
