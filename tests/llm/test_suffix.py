"""Suffix arrays, common prefixes and the removal of repeated strings against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from pactscope.llm import suffix
from tests.llm.fixtures import SCHEMA, rows


def covered(texts, length):
    """Per text, which bytes lie in a window that starts at two places or more."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        marks = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                marks[i : i + length] = True
        out.append(marks[:-1])
    return out


def test_suffix_array_and_common_prefixes():
    r = random.Random(1)
    for t in range(300):
        body = [r.randint(1, r.choice([1, 2, 3, 200])) for _ in range(r.randint(1, 80))]
        if t % 5 == 0:
            body = (body * 5)[:120]
        s = np.array([*body, 0], np.uint16)
        want = sorted(range(len(s)), key=lambda i: s[i:].tolist())
        sa = suffix.suffix_array(s)
        assert sa.tolist() == want
        before, common = suffix.common_prefixes(s, sa)
        for a, b in zip(want, want[1:], strict=False):
            same = 0
            while max(a, b) + same < len(s) and s[a + same] == s[b + same]:
                same += 1
            assert (before[b], common[b]) == (a, same)


@pytest.mark.parametrize("length", [20, 400])
def test_removal_report(spark, length):
    table = rows(n=50)
    docs = spark.createDataFrame(table, SCHEMA).repartition(3)
    texts = [(t or "").encode() for _, t, *_ in table]
    want = Counter()
    for (d, *_), t, marks in zip(table, texts, covered(texts, length), strict=True):
        kept = bytes(b for b, m in zip(t, marks, strict=True) if not m)
        spans = int(np.sum(np.diff(np.r_[0, marks.astype(int)]) == 1))
        want[d, len(t), int(marks.sum()), spans, hashlib.sha256(kept).hexdigest()] += 1
    got = suffix.removal_report(docs, length).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    assert all(len(r.text.encode()) >= r.n_bytes - r.n_removed for r in got)
    assert all(hashlib.sha256(r.text.encode()).hexdigest() == r.kept_sha256 for r in got if len(r.text.encode()) == r.n_bytes - r.n_removed)
    assert sum(r.n_removed for r in got) > 0


def test_remove_repeats_keeps_columns_and_characters(spark):
    shared = "é" * 30 + "漢字" * 100
    docs = [(1, "début " + shared + " fin", 0), (2, shared + "x", 0), (3, None, None), (4, "clean", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in suffix.remove_repeats(df, 50).collect()}
    assert suffix.remove_repeats(df, 50).schema == df.schema
    assert (got[1].text, got[2].text, got[3].text, got[4].text) == ("début  fin", "x", None, "clean")
    assert (got[1].n_chars, got[4].n_chars, got[3].n_chars) == (10, 5, None)


def test_a_shuffled_row_holds_its_text_once(spark, capsys):
    docs = spark.createDataFrame(rows(n=20), SCHEMA).select("doc_id", "text", "n_chars")
    for result in (suffix.remove_repeats(docs, 50), suffix.removal_report(docs, 50)):
        result.explain("formatted")
        dealt = re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", capsys.readouterr().out)
        wide = [re.findall(r"\b(?:text|_*data)#", columns) for columns in dealt]
        assert max(map(len, wide)) == 1


def test_the_report_deals_out_texts_once(spark, capsys):
    result = suffix.removal_report(spark.createDataFrame(rows(n=20), SCHEMA), 50)
    result.collect()
    result.explain("formatted")
    plan = capsys.readouterr().out
    ran = re.findall(r"[- ]Exchange \((\d+)\)", plan.split("Initial Plan")[0])
    texts = re.findall(r"\((\d+)\) Exchange\nInput \[3\]: \[doc_id#\d+L?, mark#\d+L, data#\d+\]", plan)
    assert len(set(ran) & set(texts)) == 1


def test_empty_table(spark):
    assert suffix.removal_report(spark.createDataFrame([], SCHEMA)).collect() == []
