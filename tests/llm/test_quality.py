"""The quality classifier: features, held-out accuracy, hard cases."""

import numpy as np

from pactscope.llm import queries, quality
from tests.llm.fixtures import SCHEMA, SF, rows


def test_features_against_plain_loops():
    def strings(text):
        words, found = text.split(" "), []
        for k, w in enumerate(words):
            found.append(("word", "again" if k and w == words[k - 1] else w))
        padded = f" {text} "
        for size in quality.GRAMS:
            found += [(size, padded[i : i + size]) for i in range(len(padded) - size + 1) if " " not in padded[i + 1 : i + size - 1]]
        return found

    bucket = {}
    for text in ("ab abc abc ab", "é漢 x", "word", "aa aa aa aa"):
        got, want = quality.features(text), strings(text)
        assert len(got) == len(want) + 1
        found = np.bincount(got[1:])
        assert sorted(found[found > 0].tolist()) == sorted(want.count(x) for x in set(want))
        bucket[text] = set(got.tolist())
    assert quality.features("").tolist() == quality.features(None).tolist() == quality.features(" \n").tolist() == [0]


def test_held_out_accuracy(spark):
    scores = queries.op1_quality_classifier(spark, SF).toPandas()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = scores.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert len(scores) == 1000 and len(held) > 60
    assert (held.predicted == held.quality).mean() >= 0.95
    assert held[held.quality == 1].score.mean() > held[held.quality == 0].score.mean() + 0.5


def test_hard_cases(spark):
    docs = spark.createDataFrame(rows(n=20), SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(None, 1), (4, None), (5, 1)], "doc_id long, quality int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows(n=20)) and all(0 <= r.score <= 1 for r in got)
    one_class = quality.quality_scores(docs, labels.filter("quality = 1")).collect()
    assert {r.predicted for r in one_class} == {1}
    assert {r.score for r in quality.quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.quality_scores(docs.limit(0), labels).collect() == []
    kept = quality.keep_good(docs, labels.filter("quality = 1"))
    assert kept.schema == docs.schema and kept.count() == docs.count()
