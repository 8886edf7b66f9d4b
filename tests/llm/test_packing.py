"""Packing: every token once, no bin too full, cost near the best possible."""

import itertools
import random
from collections import defaultdict

from pactscope.llm import packing
from tests.llm.fixtures import SCHEMA, rows, words


def check(got, want, lengths):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.bin_id].append(r)
        docs[r.doc_id].append(r)
    for items in bins.values():
        items.sort(key=lambda r: r.bin_offset)
        at = 0
        for r in items:
            assert r.bin_offset == at
            at += r.length
        assert {r.bin_size for r in items} == {min(c for c in lengths if c >= at)}
    assert {d: sorted((r.offset, r.length) for r in v) for d, v in docs.items()} == {
        d: sorted((o, min(lengths[-1], n - o)) for n in ns for o in range(0, n, lengths[-1])) for d, ns in want.items()
    }
    return sum(packing.cost(v[0].bin_size) for v in bins.values())


def test_every_token_once(spark):
    table = rows(n=80)
    want = defaultdict(list)
    for d, t, *_ in table:
        want[d].append(len(words(t)) + 1)
    got = packing.pack(spark.createDataFrame(table, SCHEMA).repartition(3)).collect()
    check(got, want, packing.LENGTHS)
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []


def test_groups_of_one_task(spark, monkeypatch):
    docs = [(i, 1 + i * 37 % 300) for i in range(400)]
    monkeypatch.setattr(packing, "GROUP", 50)
    df = spark.createDataFrame(docs, "doc_id long, n long").coalesce(1)
    got = packing.pack(df, length=packing.F.col("n"), lengths=(64, 128)).collect()
    check(got, {d: [n] for d, n in docs}, [64, 128])


def test_cost_against_all_partitions():
    """Few pieces: against the cheapest of all ways to share them out. Many: against the cost without any empty place."""
    r = random.Random(7)
    lengths = [8, 16, 32]
    ratios = []
    for _ in range(60):
        pieces = sorted((r.randint(1, 32) for _ in range(6)), reverse=True)
        best = float("inf")
        for share in itertools.product(*[range(k + 1) for k in range(6)]):
            sums = [sum(p for p, x in zip(pieces, share, strict=True) if x == b) for b in set(share)]
            if max(sums) <= 32:
                best = min(best, sum(packing.cost(next(c for c in lengths if c >= n)) for n in sums))
        _, sizes = packing.packed(pieces, lengths)
        ratios.append(sum(map(packing.cost, sizes)) / best)
    assert min(ratios) >= 1 - 1e-9 and sum(ratios) / len(ratios) < 1.03
    pieces = sorted((min(4096, int(r.lognormvariate(5.5, 1))) + 1 for _ in range(5000)), reverse=True)
    pieces = [min(p, 4096) for p in pieces]
    _, sizes = packing.packed(pieces, list(packing.LENGTHS))
    least = sum(pieces) * min(packing.cost(c) / c for c in packing.LENGTHS)
    assert sum(map(packing.cost, sizes)) < 1.03 * least
    single = packing.best_fit(pieces, [4096], 4096)[1]
    assert sum(map(packing.cost, sizes)) < len(single) * packing.cost(4096)
