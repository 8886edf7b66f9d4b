"""Fingerprints and their components against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pactscope.llm import queries, simhash
from tests.llm.fixtures import SCHEMA, SF, rows, words


def prints_by_spark(spark, texts, k):
    """Fingerprints from Spark's own XXH64 (its seed is 42), bit by bit."""
    shingles = []
    for i, text in enumerate(texts):
        w = words(text)
        n = max(1, len(w) - k + 1) if w else 0
        shingles += [(i, " ".join(w[j : j + k])) for j in range(n)]
    out = [0] * len(texts)
    if shingles:
        hashed = spark.createDataFrame(shingles, "i int, s string").select("i", F.xxhash64("s").alias("h"))
        bits = [F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)]
        for row in hashed.groupBy("i").agg(F.count("h").alias("n"), *bits).collect():
            out[row.i] = sum(1 << b for b in range(64) if 2 * row[f"b{b}"] > row.n)
    return out


def linked(prints, ids, radius):
    """The smallest id that each fingerprint reaches, by comparing all pairs."""
    prints = np.array(prints, np.uint64)
    root = np.arange(len(prints))
    for i in range(len(prints)):
        near = np.bitwise_count(prints ^ prints[i]) <= radius
        for r in set(root[near].tolist()):
            root[root == r] = root[i]
    least = {r: min((d for d, s in zip(ids, root, strict=True) if s == r and d is not None), default=None) for r in set(root.tolist())}
    return [least[r] for r in root]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_hard_rows(spark):
    table = rows(n=90)
    prints = prints_by_spark(spark, [t for _, t, *_ in table], 3)
    want = Counter(zip([r[0] for r in table], map(signed, prints), linked(prints, [r[0] for r in table], 3), strict=True))
    got = simhash.near_duplicates(spark.createDataFrame(table, SCHEMA).repartition(3)).collect()
    assert Counter(tuple(r) for r in got) == want
    assert 0 in prints


def test_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    prints = prints_by_spark(spark, [r.text for r in docs], 3)
    want = {r.doc_id: (f"{p:016x}", c) for r, p, c in zip(docs, prints, linked(prints, [r.doc_id for r in docs], 3), strict=True)}
    got = queries.op13_simhash_near_dedup(spark, SF).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == want
    assert len(got) == len(docs) > len({c for _, c in want.values()})


def scattered(seed, centres, each, flips):
    r = random.Random(seed)
    out = []
    for _ in range(centres):
        centre = r.getrandbits(64)
        for _ in range(each):
            x = centre
            for _ in range(r.randint(0, flips)):
                x ^= 1 << r.randrange(64)
            out.append(x)
    return out


@pytest.mark.parametrize(("radius", "members"), [(3, 8192), (3, 50), (0, 8192), (1, 20), (5, 8192)])
def test_components_of_fingerprints(spark, radius, members):
    """Chains, dense families and single ones; small parts make keys that fall into pairs of parts."""
    prints = sorted(set(scattered(5, 60, 12, 5) + scattered(6, 1, 400, 6) + [0, 7, (1 << 64) - 1, 1 << 63]))
    chain = 0x123456789ABCDEF0
    for k in range(64):
        chain ^= 1 << k
        prints.append(chain)
    prints = sorted(set(prints))
    random.Random(1).shuffle(prints)
    classes = spark.createDataFrame([(signed(p),) for p in prints], "print long").repartition(5).cache()
    got = {r.node: r.root for r in simhash.components(simhash.ties(classes, radius, members)).collect()}
    want = linked(prints, [signed(p) for p in prints], radius)
    assert {signed(p): got.get(signed(p), signed(p)) for p in prints} == {signed(p): w for p, w in zip(prints, want, strict=True)}


def test_every_link_shares_a_key():
    r = random.Random(2)
    for radius in (0, 1, 3, 6):
        masks = simhash.key_masks(radius)
        for _ in range(300):
            flips = sum(1 << b for b in r.sample(range(64), radius))
            assert any(flips & m == 0 for m in masks)


def test_one_task_compares_thousands():
    """A dense key of many blocks of 64, alone and in two parts, gives the components of all pairs."""
    prints = np.array(sorted(set(scattered(8, 3, 1500, 7))), np.uint64)
    n = len(prints)
    free = np.zeros(n, np.uint64)
    root = simhash.tied(prints, np.zeros(n, int), np.zeros(n, int), free, 3)
    assert root.tolist() == linked(prints.tolist(), list(range(n)), 3)
    sides = np.where(np.arange(n) < n // 3, 1, 2)
    across = simhash.tied(prints, np.zeros(n, int), sides, free, 3)
    plain = np.arange(n)
    for i in np.flatnonzero(sides == 1):
        for j in np.flatnonzero((np.bitwise_count(prints ^ prints[i]) <= 3) & (sides == 2)):
            plain[plain == plain[max(i, j)]] = plain[min(i, j)] if plain[min(i, j)] < plain[max(i, j)] else plain[max(i, j)]
            a, b = plain[i], plain[j]
            plain[(plain == a) | (plain == b)] = min(a, b)
    assert across.tolist() == plain.tolist()


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
