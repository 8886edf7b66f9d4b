"""Near duplicates by 64-bit fingerprints, compared bit-sliced.

A fingerprint bit is 1 if it is set in more than half of the XXH64 hashes (seed 42) of a text's word shingles, repeats
included. Two fingerprints are linked when they differ in `radius` bits or fewer.

1. Each whole text becomes one number where it is read; no text is shuffled. Equal fingerprints collapse to one class, with
   map-side combine, so that any number of copies costs one row.
2. The 64 bits are parted into radius + 2 blocks. A link leaves two blocks or more untouched, so every link shares one of
   the (radius + 2 choose 2) keys made of two blocks: 10 keys of 25 or 26 bits at a radius of 3. No link can be missed.
3. Members of a key are compared bit-sliced. 64 members are a block, stored vertically: word b holds bit b of all of them. A
   fingerprint meets a block plane by plane; a carry-save counter of a few words counts the differences of all 64 members at
   once and its overflow marks those beyond the radius. (fingerprint, block) pairs in which all members are marked are
   abandoned, a few planes at a time; planes inside the shared key are skipped.
4. Comparisons only serve to connect: blocks whose members all hang together with the fingerprint already are not compared,
   and each task returns its members' ties to the smallest member of their component, never all pairs.
5. Components by alternating stars over the classes, then back to the documents.

A key with more than KEY_MEMBERS different fingerprints is parted by a hash of the fingerprint, and every two parts are a
group of their own: a task holds two parts at most, whatever the key. The work within one key grows with the square of its
different fingerprints, 64 of them to a word, and spreads over tasks.

Edge cases: null, empty and blank texts have the fingerprint zero, which is linked like any other. A text of fewer words than
a shingle is one shingle. Rows that repeat a doc_id are judged each by its own text; a null doc_id is linked like others but
names no component unless all ids of it are null. An empty table gives an empty result. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactscope.llm.common import cut, small, text_bytes
from pactscope.llm.graph import components

SEED = 42
#: Different fingerprints of one key that one part holds; entries of keys that one task sorts.
KEY_MEMBERS, TASK_ENTRIES = 8192, 1 << 15
#: (fingerprint, block) pairs that are compared at a time, and planes between two checks for abandoned ones.
PAIRS, PLANES = 1 << 15, 6

_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, words: int = 3) -> int:
    """The unsigned fingerprint of a text."""
    found = text.lower().split()  # of bytes: A-Z only, and parted at 0x20 and 0x09 to 0x0D
    if not found:
        return 0
    line = b" ".join(found)
    lengths = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(lengths + 1) - 1
    width = min(words, len(found))
    starts, ends = (ends - lengths)[: len(found) - width + 1].tolist(), ends[width - 1 :].tolist()
    counts, total = np.zeros(64, np.int64), len(starts)
    for at in range(0, total, 1 << 14):
        part = zip(starts[at : at + (1 << 14)], ends[at : at + (1 << 14)], strict=True)
        hashes = np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in part], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > total, bitorder="little").tobytes(), "little")


def _prints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(text.as_py(), words) for text in batch["data"]], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and print (the fingerprint's 64 bits as a long) of each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_bytes().alias("data"))
    return texts.mapInArrow(_prints(words), f"doc_id {kind}, print long")


def key_masks(radius: int) -> list[int]:
    """The bits of each key: any two of radius + 2 blocks of the 64 bits."""
    edges = [64 * k // (radius + 2) for k in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [x | y for x, y in combinations(blocks, 2)]


def _planes(prints: np.ndarray, slots: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of members put into slots (64 to a block): one row per bit, one word per block; and the taken slots."""
    taken = np.zeros(blocks * 64, bool)
    taken[slots] = True
    laid = np.zeros(blocks * 64, np.uint64)
    laid[slots] = prints
    planes = np.empty((64, blocks), np.uint64)
    for bit in range(64):
        lanes = (laid >> np.uint64(bit)).astype(np.uint8) & np.uint8(1)
        planes[bit] = np.packbits(lanes, bitorder="little").view("<u8")
    return planes, np.packbits(taken, bitorder="little").view("<u8")


def _within(queries: np.ndarray, at: np.ndarray, planes: np.ndarray, beyond: np.ndarray, free: np.ndarray, radius: int):
    """(pair number, mask of its members within the radius) for pairs of a fingerprint and a block (at).

    beyond: members not to be looked at. free: for each pair, the bits of the key, in which it has no differences.
    """
    width = max(1, radius.bit_length())
    counter = [np.full(len(at), _ALL if ((1 << width) - 1 - radius) >> k & 1 else 0, np.uint64) for k in range(width)]
    pairs, beyond = np.arange(len(at)), beyond.copy()
    shared = np.bitwise_and.reduce(free) if len(free) else np.uint64(0)
    bits = [b for b in range(64) if not int(shared) >> b & 1]
    for done, bit in enumerate(bits):
        if done % PLANES == 0:
            alive = beyond != _ALL
            if not alive.all():
                pairs, beyond, at, queries = pairs[alive], beyond[alive], at[alive], queries[alive]
                counter = [c[alive] for c in counter]
        carry = planes[bit][at] ^ (np.uint64(0) - ((queries >> np.uint64(bit)) & np.uint64(1)))
        for k in range(width):
            counter[k], carry = counter[k] ^ carry, counter[k] & carry
        beyond |= carry
    alive = beyond != _ALL
    return pairs[alive], ~beyond[alive]


def _merge(root: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """root (the smallest member known to hang together with each) after linking x and y."""
    while True:
        a, b = root[x], root[y]
        apart = a != b
        if not apart.any():
            return root
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            higher = root[root]
            if (higher == root).all():
                break
            root = higher


def tied(prints: np.ndarray, groups: np.ndarray, sides: np.ndarray, free: np.ndarray, radius: int) -> np.ndarray:
    """For each member the place of the smallest one that it hangs together with inside its group.

    Members of a group (rows in order of group and side) share the bits `free`. side: 0 for groups that are compared in
    themselves; in a group of two parts, members of side 1 meet those of side 2.
    """
    n = len(prints)
    root = np.arange(n)
    if not n:
        return root
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    size = np.diff(np.r_[first, n])
    group = np.repeat(np.arange(len(first)), size)
    begin = np.r_[0, np.cumsum(-(-size // 64))]
    rank = np.arange(n) - first[group]
    slots = begin[group] * 64 + rank
    planes, taken = _planes(prints, slots, int(begin[-1]))
    member = np.full(begin[-1] * 64, -1)
    member[slots] = np.arange(n)
    # A member of side 1 meets the blocks from the first member of side 2 on, others those from their own on.
    twos = np.searchsorted(group * 3 + sides, group * 3 + 2)
    start = np.where(sides == 1, twos, np.arange(n) + 1) - first[group]
    last = begin[group + 1]
    meets = np.where(sides == 2, 0, last - (begin[group] + start // 64))
    meets = np.where(start >= size[group], 0, meets)
    queue = np.r_[0, np.cumsum(meets)]
    for at in range(0, int(queue[-1]), PAIRS):
        place = np.arange(at, min(at + PAIRS, int(queue[-1])))
        who = np.searchsorted(queue, place, side="right") - 1
        block = begin[group[who]] + start[who] // 64 + (place - queue[who])
        # Blocks in which all hang together with the fingerprint already say nothing new.
        roots = np.where(member >= 0, root[member], -1).reshape(-1, 64)
        same = np.where((roots == roots[:, :1]) | (roots < 0), True, False).all(axis=1)
        known = same[block] & (roots[block, 0] == root[who])
        who, block = who[~known], block[~known]
        edge = start[who] - 64 * (block - begin[group[who]])
        early = np.where(edge <= 0, np.uint64(0), (np.uint64(1) << np.minimum(np.maximum(edge, 0), 63).astype(np.uint64)) - np.uint64(1))
        pair, mask = _within(prints[who], block, planes, ~taken[block] | early, free[who], radius)
        lanes = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, lane = np.nonzero(lanes)
        root = _merge(root, who[pair[row]], member[block[pair[row]] * 64 + lane])
    return root


def _compared(masks: list[int], radius: int):
    masks = np.array(masks, np.uint64)

    def run(table: pa.Table) -> pa.Table:
        kinds, prints, lo, hi, part = (table[c].to_numpy() for c in ("kind", "print", "lo", "hi", "part"))
        prints = prints.view(np.uint64)
        side = np.where(lo == hi, 0, np.where(part == lo, 1, 2))
        keys = prints & masks[kinds]
        order = np.lexsort((prints, side, hi, lo, keys, kinds))
        keys, kinds, lo, hi, prints, side = keys[order], kinds[order], lo[order], hi[order], prints[order], side[order]
        new = (keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        group = np.r_[0, np.cumsum(new)]
        several = np.bincount(group)[group] > 1
        group, kinds, prints, side = group[several], kinds[several], prints[several], side[several]
        ties = [(prints[:0], prints[:0])]
        at = 0
        while at < len(group):  # whole groups, about as many members as one key may have
            last = group[min(at + 2 * KEY_MEMBERS, len(group)) - 1]
            stop = int(np.searchsorted(group, last, side="left"))
            stop = stop if stop > at and stop < len(group) and at + 2 * KEY_MEMBERS < len(group) else int(np.searchsorted(group, last, side="right"))
            some = slice(at, stop)
            root = tied(prints[some], group[some], side[some], masks[kinds[some]], radius)
            moved = root != np.arange(stop - at)
            ties.append((prints[some][moved], prints[some][root[moved]]))
            at = stop
        x, y = (np.concatenate(c).view(np.int64) for c in zip(*ties, strict=True))
        return pa.table({"x": x, "y": y})

    return run


def ties(classes: DataFrame, radius: int = 3, members: int = KEY_MEMBERS) -> DataFrame:
    """(x, y) of fingerprints that hang together; with their own links they connect whatever `radius` links connect.

    classes: print, each once, already written out. members: of a key that one part holds.
    """
    masks = key_masks(radius)
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), F.col("print").bitwiseAND(m - (m >> 63 << 64)).alias("key")) for k, m in enumerate(masks)])
    keyed = classes.select("print", F.inline(keys))
    crowded = keyed.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("members")).filter(F.col("members") > members)
    crowded = cut(crowded.select("kind", "key", F.ceil(F.col("members") / members).cast("int").alias("parts")))
    keyed = keyed.join(small(crowded), ["kind", "key"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64("print"), F.col("parts")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda other: F.struct(F.least("part", other).alias("lo"), F.greatest("part", other).alias("hi")),
    )
    rows = keyed.select("kind", "key", "print", "part", "parts", F.inline(pairs))
    tasks = max(1, -(-classes.count() * len(masks) // TASK_ENTRIES))
    slot = F.when(F.col("parts") > 1, F.xxhash64("kind", "key", "lo", "hi")).otherwise(F.pmod(F.xxhash64("kind", "key"), F.lit(tasks)))
    rows = rows.select(slot.alias("slot"), "kind", "print", "part", "lo", "hi")
    return rows.groupBy("slot").applyInArrow(_compared(masks, radius), "x long, y long")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3, members: int = KEY_MEMBERS) -> DataFrame:
    """One row per row of docs: doc_id, print (64 bits as a long), component_id (smallest doc_id reachable by links)."""
    prints = cut(fingerprints(docs, words))
    classes = cut(prints.groupBy("print").agg(F.min("doc_id").alias("doc")))
    linked = components(ties(classes.select("print"), radius, members))
    rooted = classes.join(linked.withColumnRenamed("node", "print"), "print", "left")
    rooted = cut(rooted.select("print", "doc", F.coalesce("root", "print").alias("root")))
    names = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = cut(rooted.join(names, "root").select("print", "component_id"))
    return prints.join(named, "print").select("doc_id", "print", "component_id")
