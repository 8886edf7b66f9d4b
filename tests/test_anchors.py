"""Texts on pages, found by anchors, against plain containment; attribution of pages against a loop."""

import random

from pyspark.sql import functions as F

from pactscope.functions import anchors
from pactscope.operators import spans
from tests.test_scale import seconds

PAGES = "doc_id long, page_no int, text string"
CLAUSES = "doc_id long, idx int, title string, text string"


def sample(seed=5):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcéΣσß漢") for _ in range(r.randint(1, 7)))
    pages = [(d, p, r.choice([" ", "\n", "  "]).join(word().title() if r.random() < 0.2 else word() for _ in range(r.randint(0, 80))))
             for d in range(6) for p in range(1, 6)]
    patterns = []
    for k in range(600):
        d, p, text = r.choice(pages)
        at = r.randint(0, max(0, len(text) - 1))
        piece = text[at : at + r.choice([0, 1, 3, 6, 9, 15, 30, 80, 400])]
        if r.random() < 0.2:
            piece = piece[:-1] + "x"
        patterns.append((d, k, piece, "raw"))
    patterns += [(0, 1000, None, "raw"), (9, 1001, "no such document", "raw"), (1, 1002, "", "raw")]
    return pages + [(3, 9, None)], patterns


def test_pages_holding(spark):
    pages, patterns = sample()
    got = {}
    wanted = spark.createDataFrame(patterns, "doc_id long, k int, pattern string, test string")
    for r in spans.pages_holding(wanted, spark.createDataFrame(pages, PAGES).repartition(3), ["k"]).collect():
        got.setdefault(r.k, set()).add(r.found)
    for d, k, pattern, _ in patterns:
        want = {p for doc, p, text in pages if doc == d and pattern is not None and text is not None and pattern in text}
        assert got[k] - {None} == want, (k, pattern)


def test_other_forms(spark):
    pages = spark.createDataFrame([(1, 1, "The  CLIENT\nShall pay all fees of ΣΟΦΟΣ now"), (1, 2, "nothing")], PAGES)
    rows = [(1, 1, "the client shall pay all", "flat"), (1, 2, "client\nshall pay", "low"), (1, 3, "the client shall pay all", "raw"), (1, 4, "Shall pay", "raw")]
    found = spans.pages_holding(spark.createDataFrame(rows, "doc_id long, k int, pattern string, test string"), pages, ["k"])
    assert {r.k: r.p for r in found.groupBy("k").agg(F.max("found").alias("p")).collect()} == {1: 1, 2: 1, 3: None, 4: 1}


def test_anchors_of_parts_are_among_those_of_the_whole(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("abcdeé漢") for _ in range(r.randint(0, 200))) for _ in range(200)]
    rows = [(t, t[i : i + r.randint(0, 60)]) for t in texts for i in (r.randint(0, 150),)]
    df = spark.createDataFrame([(a, b) for a, b in rows] + [(None, None)], "a string, b string").coalesce(2)
    for kind in (anchors.LONG, anchors.SHORT):
        for row in df.select("b", anchors.page_anchors(F.col("a"), kind).alias("p"), anchors.pattern_anchor(F.col("b"), kind).alias("k")).collect():
            assert (row.k is None) == (len((row.b or "").encode()) < anchors.least_bytes(kind))
            assert row.k is None or row.k in row.p
            assert len(set(row.p)) == len(row.p)


def test_attribution(spark):
    body = "shall be carried out with due care by both sides of this contract"
    pages = [(1, 1, f"Alpha {body}. Beta {body}."), (1, 2, f"Beta {body}. Gamma {body}."), (1, 3, "5. Delta Services\nThe long first line of it all\nrest")]
    clauses = [
        (1, 1, "1. Alpha", f"Alpha {body}."), (1, 2, "2. x", f"Gamma {body}."), (1, 3, "3. y", f"BETA {body}"), (1, 4, "4. z", "short"),
        (1, 5, "5. Delta Services", "Nothing like it"), (1, 6, "6. w", "unknown start\nThe long first line of it all\nno more"), (1, 7, "7.", None), (2, 1, "no pages", "here"),
    ]
    got = {(r.doc_id, r.idx): r.page_no for r in spans.attribute_pages(spark.createDataFrame(clauses, CLAUSES), spark.createDataFrame(pages, PAGES)).collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (1, 3): 2, (1, 4): 2, (1, 5): 3, (1, 6): 3, (1, 7): 3, (2, 1): 1}


def test_twice_the_clauses_take_twice_the_time(spark):
    def run(n):
        clauses = spark.range(n).select(
            F.lit(1).cast("long").alias("doc_id"), F.col("id").cast("int").alias("idx"), F.concat(F.lit("Title number "), "id").alias("title"),
            F.concat(F.sha2(F.col("id").cast("string"), 256), F.lit(" "), F.sha2(F.concat(F.lit("b"), "id"), 512)).alias("text"),
        )
        pages = clauses.groupBy("doc_id", (F.col("idx") / 3).cast("int").alias("page_no")).agg(F.array_join(F.collect_list("text"), "\n").alias("text"))
        return spans.attribute_pages(clauses.persist(), pages.persist())

    run(500).count()
    small, large = seconds(run(6_000)), seconds(run(12_000))
    assert large < 2.2 * small + 0.5


