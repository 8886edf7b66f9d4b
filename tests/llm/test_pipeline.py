"""The pipeline's stages against brute force, each on its own input."""

from collections import Counter

import corpus_pipeline
from pactscope.llm import packing
from tests.llm.fixtures import SF, near, words


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    planted = docs.limit(40).withColumn("doc_id", packing.F.col("doc_id") + 100_000)
    docs = docs.unionByName(planted)
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == columns, name
        kept = {r.doc_id: r.text for r in after.collect()}
        if name == "quality_classifier":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            assert sum((d in kept) == (q == 1) for d, q in labels.items()) >= 0.95 * len(labels)
        if name == "exact_dedup":
            most = {}
            for d, t in before.items():
                most[t] = max(d, most.get(t, d))
            assert set(kept) == set(most.values())
        if name == "minhash_near_dedup":
            table = list(before.items())
            roots, sizes = near(table, 5)
            assert set(kept) == {d for i, (d, _) in enumerate(table) if sizes[i] == 0 or roots[i] == d}
        if name == "suffix_array_dedup":
            assert set(kept) == set(before)
            size = corpus_pipeline.PASSAGE
            def windows(t):
                t = t.encode()
                return [t[i : i + size] for i in range(len(t) - size + 1)]

            old = Counter(w for t in before.values() for w in windows(t))
            assert all(kept[d] == t for d, t in before.items() if all(old[w] == 1 for w in windows(t)))
            assert any(kept[d] != t for d, t in before.items())
            assert not [w for t in kept.values() if t.isascii() for w in windows(t) if old[w] > 1]
        docs = spark.createDataFrame(after.collect(), after.schema)
        before = kept
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    placed = Counter()
    for r in packed:
        placed[r.doc_id] += r.length
    assert placed == Counter({d: len(words(t)) + 1 for d, t in before.items()})


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.columns == ["doc_id", "piece", "offset", "length", "bin_id", "bin_size", "bin_offset"]
    assert rows.count() > 500
