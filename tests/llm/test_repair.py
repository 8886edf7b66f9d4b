"""Repair of conversations against a search over all edits and the full table of spans."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from pactscope.llm import queries, repair

SCHEMA = "conv_id long, turn long, role string, text string, at long, digest string, fault string, number int, audit string"
ROLES = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
TEXTS = ["Yes.", "no", "Why?", " \n\t", "", None, "Go on!  ", "well…", "Yes. And", "x. " * 300, "Né."]


def conversations(seed=1, n=250):
    r = random.Random(seed)
    out = []
    for conv in range(n):
        turns = [(conv if conv else None, r.choice([None, k, k, k, k + r.randint(0, 3)]), r.choice(ROLES[: r.choice([3, 5, 8])]), r.choice(TEXTS))
                 for k in range(r.randint(1, 9))]
        out += turns + r.choices(turns, k=r.choice([0, 0, 1, 2]))
    r.shuffle(out)
    return [(*row, 1, "x", "y", 2, "z") for row in out]


def in_order(rows):
    """Turns of a conversation as the operator orders them."""
    told = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    return sorted(told, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2][: repair.HEAD].encode(), hashlib.sha256(x[2].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)[-1:]
        out.append(1 if not last else 2 if (role, text) in seen else 3 if last not in ".!?" else 0)
        seen.add((role, text))
    return out


def search(rows, judged):
    """The least (cost, audit, repaired turns), turn by turn over all edits."""
    moves = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    names = {"u": "user", "a": "assistant"}

    def inserted(states):
        for _ in range(2):
            for p, (cost, audit, turns) in list(states.items()):
                for role in "ua":
                    q = moves.get((p, role))
                    if q is not None:
                        new = (cost + 5, audit + "I", turns + [(names[role], "")])
                        states[q] = min(states.get(q, new), new, key=lambda x: x[:2])
        return states

    states = inserted({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, judged, strict=True):
        after = {}

        def offer(q, cost, audit, turns, after=after):
            if q not in after or (cost, audit) < after[q][:2]:
                after[q] = (cost, audit, turns)

        for p, (cost, audit, turns) in states.items():
            offer(p, cost + 2, audit + "D", turns)
            if fault not in (1, 2):
                more = 5 if fault == 3 else 0
                if (p, role[:1]) in moves:
                    offer(moves[p, role[:1]], cost + more, audit + "K", turns + [(role, text)])
                for new in "ua":
                    if (p, new) in moves:
                        offer(moves[p, new], cost + more + 1, audit + "R", turns + [(names[new], text)])
        states = inserted(after)
    return min((states[q] for q in (0, 3) if q in states), key=lambda x: x[:2])


def wanted(rows):
    rows = in_order(rows)
    judged = faults(rows)
    cost, audit, turns = search(rows, judged)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    lines = "\n".join(f"{r}:{t}" for r, t in turns)
    return gaps, judged.count(1), judged.count(2), judged.count(3), illegal, cost, audit, hashlib.sha256(lines.encode()).hexdigest()


def by_conversation(rows):
    groups = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        groups[conv].append((turn, role, text))
    return groups


@pytest.mark.parametrize("partitions", [1, 7])
def test_hard_rows(spark, partitions):
    table = conversations()
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found, turns = repair.repair(spark.createDataFrame(table, SCHEMA).repartition(3))
        lines = defaultdict(list)
        for r in turns.collect():
            lines[r.conv_id].append((r.number, f"{r.role}:{r.text}"))
            assert not r.inserted or r.text == ""
        got = {}
        for r in found.collect():
            said = sorted(lines[r.conv_id])
            assert [n for n, _ in said] == list(range(len(said)))
            sha = hashlib.sha256("\n".join(x for _, x in said).encode()).hexdigest()
            gaps = r.most - r.least + 1 - r.numbers if r.most is not None else 0
            got[r.conv_id] = (gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit.upper(), sha)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    want = {conv: wanted(rows) for conv, rows in by_conversation(table).items()}
    assert got == want
    letters = Counter("".join(w[6] for w in want.values()))
    assert all(letters[x] for x in "DKR")


def test_every_split_gives_the_same_cell():
    """The full table of spans with all splits, against spans of doubling length."""
    r = random.Random(4)
    inserted = 0
    for _ in range(40):
        leaves = [repair.leaf(r.choice("sua") if r.random() < 0.9 else "t", r.random() < 0.15, r.random() < 0.2, r.choice([1, 1, 1, 3])) for _ in range(r.randint(1, 9))]
        n = len(leaves)
        table = {(i, i + 1): leaves[i] for i in range(n)}
        for length in range(2, n + 1):
            for i in range(n - length + 1):
                cells = [repair.product(table[i, k], table[k, i + length]) for k in range(i + 1, i + length)]
                assert all(c == cells[0] for c in cells)
                table[i, i + length] = cells[0]
        while len(leaves) > 1:
            leaves = [repair.product(*leaves[k : k + 2]) if k + 1 < len(leaves) else leaves[k] for k in range(0, len(leaves), 2)]
        assert leaves[0] == table[0, n]
        inserted += any("I" in audit for _, audit in leaves[0].values())
    assert inserted


def test_a_conversation_over_all_partitions(spark):
    """One conversation holds most of the turns; a turn that is said thousands of times is one row with a count."""
    r = random.Random(7)
    table = [(1, k, r.choice(["user", "assistant"]), f"{k % 977} {r.choice(['.', '', '?'])}") for k in range(6000)]
    table += [(1, 9000, "user", "again")] * 3000 + [(2, 0, "user", "a."), (2, 1, "assistant", "b.")]
    turns = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = repair.ordered(turns)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    most = Counter(r.p for r in rows.selectExpr("at >> 33 as p").collect())
    assert len(most) > 4
    assert max(most.values()) < 3000
    got = {r.conv_id: (r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit.upper()) for r in repair.repairs(turns, rows).collect()}
    for conv, said in by_conversation(table).items():
        assert got[conv] == wanted(said)[1:7]


def test_query(spark, tmp_path):
    """Damage and digests, from plain lists; a conversation without turns after damage keeps its row."""
    table = [row[:4] for row in conversations(seed=9, n=120)]
    lost = next(k for k in range(10_000, 20_000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    table.append((lost, 0, "user", "gone."))
    spark.createDataFrame(table, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for conv, turn, role, text in table:
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    want = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in table}
    want |= {conv: wanted(rows) for conv, rows in by_conversation(damaged).items()}
    got = queries.op11_conversation_repair(spark, str(tmp_path)).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == want
    assert len(got) == len(want)
    assert want[lost][6] == ""


def test_empty_table(spark):
    found, turns = repair.repair(spark.createDataFrame([], SCHEMA))
    assert found.collect() == []
    assert turns.collect() == []
