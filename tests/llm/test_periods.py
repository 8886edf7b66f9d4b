"""Periodic runs against a loop over all lags."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np

from pactscope.llm import periods, queries
from tests.llm.fixtures import SCHEMA, rows, words


def all_runs(w):
    """Every run (start, length, period) of a list, lag by lag."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())



def words_kept(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text)


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def repetitive(seed, n=150):
    """Lists of words with nested, neighbouring, long and nearly periodic repeats."""
    r = random.Random(seed)
    out = []
    for _ in range(n):
        w, alphabet = [], "abcdefgh"[: r.choice([1, 2, 3, 8])]
        for _ in range(r.randint(1, 5)):
            unit = [r.choice(alphabet) for _ in range(r.choice([1, 2, 3, 5, 8, 13, 30]))]
            if r.random() < 0.4:
                unit = unit * r.randint(2, 6) + [r.choice(alphabet)]
            part = unit * r.randint(1, 7)
            w += part[: len(part) - r.randint(0, len(unit) - 1)]
            if r.random() < 0.3:
                w[r.randrange(len(w))] = "x"
        out.append(w)
    return out


def test_runs_of_lists():
    """Every binary list of up to 12 words, and repetitive lists laid behind each other in one block."""
    lists = [[c for c in format(x, f"0{n}b")] for n in range(1, 13) for x in range(1 << n)] + repetitive(3) + [[]]
    ids = {c: k for k, c in enumerate("01abcdefghx")}
    hashes = periods.common.stream(9, len(ids))
    flat = np.array([hashes[ids[c]] for w in lists for c in w], np.uint64)
    got = periods.runs_of(flat, np.array([len(w) for w in lists]))
    assert [list(map(tuple, g)) for g in got] == [all_runs(w) for w in lists]


def test_lag_classes_leave_no_gap():
    last = 0
    for low, high, k in periods.lag_classes(100_000):
        assert low == last + 1
        assert high >= low
        assert k >= 2 * high
        assert all(k <= max(6 - q, 3 * q) for q in (low, high))
        last = high
    assert last == 100_000


def test_rows_of_a_table(spark):
    table = rows(n=40) + [(1000 + i, " ".join(w), "en", "s", 1, "x", 1, None) for i, w in enumerate(repetitive(4))]
    table.append((5000, "la " * 30_000, None, None, None, None, None, None))
    table.append((5001, "a b a b\n\na\tb a b  a b", None, None, None, None, None, None))
    got = periods.periodic_runs(spark.createDataFrame(table, SCHEMA).repartition(3)).collect()
    want = Counter()
    for d, t, *_ in table:
        w = words_kept(t or "")
        runs = [(0, 30_000, 1)] if d == 5000 else all_runs(w) if len(w) < 5000 else []
        want[d, len(w), tuple(runs), collapsed(w, runs)] += 1
    assert Counter((r.doc_id, r.n_words, tuple(tuple(x) for x in r.runs), r.collapsed) for r in got) == want
    assert any(n > 2 for n in Counter(len(r.runs) for r in got))


def test_blocks_of_any_size(spark, monkeypatch):
    """Small blocks, with texts beyond a block, find the same."""
    table = [(i, " ".join(w)) for i, w in enumerate(repetitive(6))]
    docs = spark.createDataFrame(table, "doc_id long, text string").coalesce(1)
    batch = docs.selectExpr("doc_id", "cast(text as binary) data").toArrow().combine_chunks().to_batches()
    whole = [r for b in periods._found(iter(batch)) for r in b.to_pylist()]
    monkeypatch.setattr(periods, "BLOCK_BYTES", 50)
    parts = [r for b in periods._found(iter(batch)) for r in b.to_pylist()]
    assert whole == parts
    assert len(whole) == len(table)


def test_query(spark, tmp_path):
    """Planted repeats and digests, from plain lists."""
    table = [(d, t) for d, t, *_ in rows(n=60) if len(t or "") < 5000] + [(10_000 + i, " ".join(w)) for i, w in enumerate(repetitive(7, 40))]
    spark.createDataFrame(table, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for d, t in table:
        w = words_kept(t or "")
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
        runs = all_runs(w)
        s, n, q = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
        shas = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(w, runs))]
        want[d, len(runs), s, n, q, 1000 * n // q if q else None, *shas] += 1
    got = queries.op12_periodic_runs(spark, str(tmp_path))
    assert Counter(tuple(r) for r in got.collect()) == want


def test_empty_table(spark):
    assert periods.periodic_runs(spark.createDataFrame([], SCHEMA)).collect() == []
