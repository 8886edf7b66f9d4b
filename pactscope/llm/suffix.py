"""Removal of repeated byte strings with suffix arrays, built shard by shard through induced sorting.

A window is a string of `length` bytes of one text. Windows are dealt to shards by content: among the hashes of all
GRAM-byte strings inside a window the smallest is its anchor, so equal windows have equal anchors. Windows in a row with
one anchor form a segment (their bytes, once), and every window lies in exactly one segment. Anchors that stand at one
place of the whole corpus only can't belong to a repeated window; the other segments are grouped by anchor into shards.

Within a shard, equal segments are one string with a count. The strings are joined with separators and their suffixes
sorted: suffixes are classified, leftmost-smaller substrings are sorted and named, the string of names is sorted the same
way (by doubling once its alphabet is large), and the order of all suffixes is induced bucket by bucket in two linear
passes. Common prefixes are computed in text order: only irreducible ones are compared, the others follow from the one
before. A window repeats if its common prefix with a neighbour is long enough, or if its segment was counted twice.

Text is shuffled once for finding segments and cutting them out (Spark reuses that exchange), and once with the other
columns for the final cut, where there are any; a row that is dealt out holds its text once. Equal
segments are combined by digests before any of their bytes move: one owner of each different segment sends it to its shard.
A counted segment that is alone with its anchor needs no shard, all its windows repeat. An anchor shared by many different
segments stays one shard's work.

Edge cases: null counts as empty; texts shorter than a window keep all bytes. Rows that repeat id and text repeat each
other. An empty table gives an empty result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pactscope.llm import common
from pactscope.llm.common import fresh, text_bytes

#: Bytes hashed for an anchor.
GRAM = 48
#: Bytes of text for each shard that candidate segments are dealt to.
SHARD_BYTES = 1 << 20


# --- Suffix arrays in numpy ---------------------------------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol, a unique smallest one, counts as smaller."""
    step = np.diff(s.astype(np.int64))
    known = np.flatnonzero(step)
    if not len(known):
        return np.ones(len(s), bool)
    at = np.searchsorted(known, np.arange(len(step)))
    out = np.ones(len(s), bool)
    out[:-1] = step[known[np.minimum(at, len(known) - 1)]] > 0
    return out


def _packed(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, bits: int, per: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for k in range(per):
        at = starts + k
        inside = at < ends
        out = (out << np.uint64(bits)) | np.where(inside, codes[np.minimum(at, len(codes) - 1)], np.uint64(0))
    return out


def _named(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """For each leftmost-smaller substring, how many of them are smaller than it (equal ones share the number)."""
    codes = (s.astype(np.uint64) << np.uint64(1)) | smaller
    bits = int(codes.max()).bit_length()
    per = max(1, 63 // bits)
    ends = np.r_[lms[1:] + 1, len(s)]
    rank = np.zeros(len(lms), np.int64)
    open_, at = np.arange(len(lms)), lms.copy()
    while len(open_):
        key = _packed(codes, at[open_], ends[open_], bits, per)
        order = np.lexsort((key, rank[open_]))
        key, ids = key[order], open_[order]
        group = rank[ids]
        new = np.r_[True, (key[1:] != key[:-1]) | (group[1:] != group[:-1])]
        top = np.r_[True, group[1:] != group[:-1]]
        place = np.arange(len(ids))
        first = np.maximum.accumulate(np.where(new, place, 0))
        start = np.maximum.accumulate(np.where(top, place, 0))
        rank[ids] = group + first - start
        at[open_] += per
        open_ = open_[at[open_] < ends[open_]]
    return rank


def _doubled(rank: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of numbers, each the count of smaller symbols: names of pairs, pairs of pairs ..."""
    n, h = len(rank), 1
    rank = rank.copy()
    while True:
        counts = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(counts[rank] > 1)
        if not len(open_):
            return np.argsort(rank, kind="stable")
        far = open_ + h
        second = np.where(far < n, rank[np.minimum(far, n - 1)] + 1, 0)
        order = np.lexsort((second, rank[open_]))
        ids, second = open_[order], second[order]
        group = rank[ids]
        top = np.r_[True, group[1:] != group[:-1]]
        new = top | np.r_[True, second[1:] != second[:-1]]
        place = np.arange(len(ids))
        fresh_rank = group + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(top, place, 0))
        rank[ids] = fresh_rank
        h *= 2


def _place(sa: np.ndarray, s: np.ndarray, at: np.ndarray, where: np.ndarray, down: bool) -> None:
    """Appends positions to the buckets of their symbols, in the given order, from heads up or from tails down."""
    symbols = s[where]
    order = np.argsort(symbols, kind="stable")
    symbols, where = symbols[order], where[order]
    begins = np.flatnonzero(np.r_[True, symbols[1:] != symbols[:-1]])
    sizes = np.diff(np.r_[begins, len(symbols)])
    offset = np.arange(len(symbols)) - np.repeat(begins, sizes)
    if down:
        sa[at[symbols] - offset] = where
        at[symbols[begins]] -= sizes
    else:
        sa[at[symbols] + offset] = where
        at[symbols[begins]] += sizes


def _induced(s: np.ndarray, smaller: np.ndarray, lms: np.ndarray, sigma: int) -> np.ndarray:
    """The suffix array from the order of the leftmost-smaller suffixes."""
    n = len(s)
    sizes = np.bincount(s, minlength=sigma)
    begins = np.r_[0, np.cumsum(sizes)[:-1]]
    sa = np.full(n, -1, np.int64)
    heads, seeds = begins.copy(), np.searchsorted(s[lms], np.arange(sigma + 1))
    used = np.flatnonzero(sizes)

    def before(found: np.ndarray, kind: bool) -> np.ndarray:
        found = found[found > 0] - 1
        return found[smaller[found] == kind]

    for c in used:  # larger suffixes, from the smallest symbol up; a wave holds what the one before put into this bucket
        done = begins[c]
        while done < heads[c]:
            wave, done = sa[done : heads[c]].copy(), heads[c]
            if len(found := before(wave, False)):
                _place(sa, s, heads, found, False)
        if seeds[c] < seeds[c + 1] and len(found := before(lms[seeds[c] : seeds[c + 1]], False)):
            _place(sa, s, heads, found, False)
    tails = begins + sizes - 1
    for c in used[::-1]:  # smaller suffixes, from the largest symbol down
        if c == s[-1]:
            break
        done = begins[c] + sizes[c] - 1
        while done > tails[c]:
            wave, done = sa[tails[c] + 1 : done + 1][::-1].copy(), tails[c]
            if len(found := before(wave, True)):
                _place(sa, s, tails, found, True)
        if begins[c] < heads[c] and len(found := before(sa[begins[c] : heads[c]][::-1], True)):
            _place(sa, s, tails, found, True)
    sa[0] = n - 1
    return sa


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of small numbers that ends in a unique smallest one."""
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    if not len(lms):
        return np.arange(len(s))[::-1]
    rank = _named(s, smaller, lms)
    _, names = np.unique(rank, return_inverse=True)
    distinct = int(names.max()) + 1
    if distinct == len(lms):
        order = np.argsort(rank)
    elif distinct < 1000 and distinct * 64 < len(lms):
        order = suffix_array(names)
    else:
        order = _doubled(rank)
    return _induced(s, smaller, lms[order], int(s.max()) + 1)


def common_prefixes(s: np.ndarray, sa: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In text order: the suffix before each suffix in the array (-1 for the first), and the length of their common prefix."""
    n = len(s)
    phi = np.full(n, -1, np.int64)
    phi[sa[1:]] = sa[:-1]
    prior = phi - 1
    here = np.arange(n)
    reducible = (here > 0) & (prior >= 0)
    reducible &= s[np.maximum(here - 1, 0)] == s[np.maximum(prior, 0)]
    irreducible = np.flatnonzero(~reducible)
    plcp = np.zeros(n, np.int64)
    padded = np.r_[s.astype(np.uint16), np.zeros(4, np.uint16)]
    four = np.ndarray((n,), "<u8", padded.data, 0, (2,))
    open_ = irreducible[phi[irreducible] >= 0]
    a, b = open_.copy(), phi[open_]
    while len(open_):
        go = np.flatnonzero(np.maximum(a, b) < n)
        differ = np.zeros(len(open_), np.uint64)
        differ[go] = four[a[go]] ^ four[b[go]]
        same = np.maximum(a, b) < n
        same[go] = differ[go] == 0
        low = differ & (~differ + np.uint64(1))
        plcp[open_] += np.where(differ == 0, 4 * same, np.searchsorted(np.array([1 << 16, 1 << 32, 1 << 48], np.uint64), low, "right"))
        open_, a, b = open_[same], a[same] + 4, b[same] + 4
    last = np.maximum.accumulate(np.where(reducible, 0, here))
    plcp = np.where(reducible, plcp[last] - (here - last), plcp)
    return phi, np.minimum(plcp, n - np.maximum(here, phi))


def repeated_starts(strings: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each string, where windows start that also start elsewhere in it or in another one, or in a counted copy."""
    parts = [np.zeros(1, np.uint16)]
    for x in strings:
        parts += [np.frombuffer(x, np.uint8).astype(np.uint16) + np.uint16(2), np.ones(1, np.uint16)]
    s = np.concatenate([*parts[1:], parts[0]])
    phi, plcp = common_prefixes(s, suffix_array(s))
    found = np.zeros(len(s), bool)
    long = np.flatnonzero(plcp >= length)
    found[long] = True
    found[phi[long]] = True
    out, at = [], 0
    for x, n in zip(strings, counts, strict=True):
        windows = max(0, len(x) - length + 1)
        out.append(np.arange(windows) if n > 1 else np.flatnonzero(found[at : at + windows]))
        at += len(x) + 1
    return out


# --- Anchors ------------------------------------------------------------------------------------------------------------


def _extreme(x: np.ndarray, width: int, op: np.ufunc, fill: int) -> np.ndarray:
    """The least or largest of every `width` neighbours."""
    n = len(x)
    rows = -(-n // width)
    grid = np.full(rows * width, np.uint64(fill))
    grid[:n] = x
    grid = grid.reshape(rows, width)
    forth = op.accumulate(grid, axis=1).ravel()
    back = op.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return op(back[: n - width + 1], forth[width - 1 : n])


def _anchors(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each GRAM bytes, and the anchor of each window."""
    gram = min(GRAM, length)
    sums = common.byte_hashes(np.frombuffer(text, np.uint8))
    _, back = common._powers(len(sums))
    hashes = (sums[gram:] - sums[:-gram]) * back[: len(sums) - gram]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    return hashes, _extreme(hashes, length - gram + 1, np.minimum, 0xFFFFFFFFFFFFFFFF)


def _places(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct anchors of a text, and at how many places each stands."""
    if len(text) < length:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, anchors = _anchors(text, length)
    width = len(hashes) - len(anchors) + 1
    pad = np.zeros(width - 1, np.uint64)
    highest = _extreme(np.concatenate([pad, anchors, pad]), width, np.maximum, 0)
    return np.unique(hashes[hashes == highest], return_counts=True)


def _segments(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last window of each segment, and its anchor."""
    _, anchors = _anchors(text, length)
    begins = np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])
    return begins, np.r_[begins[1:] - 1, len(anchors) - 1], anchors[begins]


def _located(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_places(x.as_py(), length) for x in batch["data"]]
            if not found:
                continue
            at = pa.array(np.repeat(np.arange(len(found)), [len(a) for a, _ in found]))
            anchors = np.concatenate([a for a, _ in found]).astype(np.int64)
            places = np.concatenate([n for _, n in found]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].take(at), batch["mark"].take(at), pa.array(anchors), pa.array(places)],
                names=["doc_id", "mark", "anchor", "places"],
            )

    return run


def _parted(length: int):
    """The segments of a text whose anchors are in its list: where they start, how many windows, anchor, digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, places, windows, anchors, digests = [], [], [], [], []
            for k, (text, wanted) in enumerate(zip(batch["data"], batch["anchors"], strict=True)):
                text = text.as_py()
                first, last, anchor = _segments(text, length)
                keep = np.isin(anchor, np.array(wanted.as_py(), np.int64).astype(np.uint64))
                first, last = first[keep], last[keep]
                at.append(np.full(len(first), k))
                places.append(first)
                windows.append(last - first + 1)
                anchors.append(anchor[keep].astype(np.int64))
                digests += [
                    hashlib.blake2b(text[a : b + length], digest_size=16).digest()
                    for a, b in zip(first.tolist(), last.tolist(), strict=True)
                ]
            if at:
                at = pa.array(np.concatenate(at))
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].take(at), batch["mark"].take(at), *(pa.array(np.concatenate(c)) for c in (places, windows, anchors)),
                     pa.array(digests, pa.binary())],
                    names=["doc_id", "mark", "place", "windows", "anchor", "digest"],
                )

    return run


def _sent(length: int):
    """The bytes of the segments that a text owns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                {"shard": x["shard"], "digest": x["digest"], "copies": x["copies"],
                 "string": text[x["place"] : x["place"] + x["windows"] + length - 1]}
                for text, owned in zip((t.as_py() for t in batch["data"]), (o.as_py() for o in batch["owned"]), strict=True)
                for x in owned
            ]
            kinds = {"shard": pa.int64(), "digest": pa.binary(), "copies": pa.int64(), "string": pa.binary()}
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], names=list(kinds))

    return run


def _matched(length: int):
    """Of one shard: the digest of each segment with repeated windows, and the first and last start of each run of them."""

    def run(table: pa.Table) -> pa.Table:
        starts = repeated_starts(table["string"].to_pylist(), table["copies"].to_pylist(), length)
        runs = []
        for x in starts:
            begins = np.flatnonzero(np.r_[True, np.diff(x) != 1]) if len(x) else x
            lasts = np.r_[begins[1:] - 1, len(x) - 1] if len(x) else x
            runs.append(np.stack([x[begins], x[lasts]], 1).ravel().tolist() if len(x) else [])
        out = pa.table({"digest": table["digest"], "runs": pa.array(runs, pa.list_(pa.int64()))})
        return out.filter(pa.array([bool(r) for r in runs], pa.bool_()))

    return run


def repeated_runs(texts: DataFrame, length: int) -> DataFrame:
    """From texts (doc_id, mark, data), mark a hash of data: doc_id, mark, runs [(place, starts of repeated windows)]."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    shards = max(1, (texts.agg(F.sum(F.length("data"))).first()[0] or 0) // SHARD_BYTES)

    def of_texts(found: DataFrame, column: str) -> DataFrame:
        found = found.select(F.col("doc_id").alias("id"), F.col("mark").alias("m"), column)
        same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("mark") == F.col("m"))
        return texts.join(found, same).select("doc_id", "mark", "data", column)

    located = texts.mapInArrow(_located(length), f"doc_id {kind}, mark long, anchor long, places int")
    repeated = located.groupBy("anchor").agg(F.sum("places").alias("places")).filter("places > 1").select("anchor")
    lists = located.join(repeated, "anchor", "left_semi").groupBy("doc_id", "mark").agg(F.collect_set("anchor").alias("anchors"))
    segments = of_texts(lists, "anchors").mapInArrow(
        _parted(length), f"doc_id {kind}, mark long, place long, windows long, anchor long, digest binary"
    )
    strings = segments.groupBy("anchor", "digest").agg(
        F.count(F.lit(1)).alias("copies"), F.min(F.struct("doc_id", "mark", "place", "windows")).alias("owner")
    )
    strings = strings.withColumn("kinds", F.count(F.lit(1)).over(Window.partitionBy("anchor")))
    alone = (F.col("kinds") == 1) & (F.col("copies") > 1)
    whole = strings.filter(alone).select("digest", F.array(F.lit(0).cast("long"), F.col("owner.windows") - 1).alias("runs"))
    owned = strings.filter(~alone).select(
        "owner.doc_id", "owner.mark", F.struct("owner.place", "owner.windows", "digest", "copies",
                                               F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).alias("one")
    ).groupBy("doc_id", "mark").agg(F.collect_list("one").alias("owned"))
    sent = of_texts(owned, "owned").mapInArrow(_sent(length), "shard long, digest binary, copies long, string binary")
    matched = whole.unionByName(sent.groupBy("shard").applyInArrow(_matched(length), "digest binary, runs array<long>"))
    found = segments.select("doc_id", "mark", "place", "digest").join(matched, "digest")
    return found.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("place", "runs")).alias("runs"))


def _spans(runs: list[dict] | None, length: int) -> list[tuple[int, int]]:
    """The maximal covered byte ranges."""
    if not runs:
        return []
    pairs = np.concatenate([np.array(r["runs"], np.int64).reshape(-1, 2) + r["place"] for r in runs])
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    begins, ends = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] + length)
    new = np.flatnonzero(np.r_[True, begins[1:] > ends[:-1]])
    return list(zip(begins[new].tolist(), ends[np.r_[new[1:] - 1, len(ends) - 1]].tolist(), strict=True))


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def _with_runs(docs: DataFrame, length: int, data: Column, mark: str, runs: str) -> DataFrame:
    """docs, whose texts in bytes are data, with two more columns: a hash of them, and the runs of repeated windows (null: none)."""
    marked = F.xxhash64(data).alias(mark)
    found = repeated_runs(docs.select("doc_id", marked.alias("mark"), data.alias("data")), length)
    key = fresh(docs, "found_id"), fresh(docs, "found_mark")
    found = found.toDF(*key, runs)
    others = [c for c in docs.columns if c != "doc_id"]
    return docs.select("doc_id", marked, *others).join(
        found, F.col("doc_id").eqNullSafe(F.col(key[0])) & (F.col(mark) == F.col(key[1])), "left"
    ).drop(*key)


def _digested(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, runs in zip(batch["data"], batch["runs"], strict=True):
                text, spans = text.as_py(), _spans(runs.as_py(), length)
                digest = hashlib.sha256(_kept(text, spans)).hexdigest()
                rows.append((len(text), sum(b - a for a, b in spans), len(spans), digest, _shortened(text, spans)))
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"],
            )

    return run


def removal_report(docs: DataFrame, length: int = 400) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 of the bytes that stay, and these as text
    (characters that a removed run covers in part stay whole)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", text_bytes().alias("data"))
    found = _with_runs(texts, length, F.col("data"), "mark", "runs")
    return found.select("doc_id", "data", "runs").mapInArrow(
        _digested(length), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
    )


def _shortened(text: bytes, spans: list[tuple[int, int]]) -> str:
    """What stays as text: characters that a span covers in part stay whole."""
    whole = []
    for a, b in spans:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        whole.append((a, b))
    return _kept(text, whole).decode("utf-8", "replace")


def _rewritten(length: int, names: list[str], runs: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                _shortened(text, _spans(found.as_py(), length))
                for text, found in zip(batch["text"].cast(pa.binary()).to_pylist(), batch[runs], strict=True)
            ]
            columns = {n: batch[n] for n in names} | {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names=names)

    return run


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs whose texts have lost every repeated string of so many bytes; n_chars, if there, follows the new text."""
    names, mark, runs = docs.columns, fresh(docs, "mark"), fresh(docs, "runs")
    found = _with_runs(docs, length, text_bytes(), mark, runs).select(*names, runs)
    schema = docs.select(*names).schema
    changed = found.filter(F.col(runs).isNotNull()).mapInArrow(_rewritten(length, names, runs), schema)
    if "n_chars" in names:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.filter(F.col(runs).isNull()).select(*names).unionByName(changed)
