"""A quality classifier of supervised subword embeddings.

Every word and every string of GRAMS characters inside a word (with a blank at each end) has a learned vector, found by
hashing into BUCKETS rows. A word that repeats the one before counts as the word "again". A document is the average of the
vectors of all its features plus one constant feature; a softmax over two classes follows. Stochastic gradient descent in
numpy trains vectors and output weights together.

Training reads a bounded sample: the SAMPLE labelled rows whose ids have the smallest hashes, and of these, in that order,
no more than FEATURES distinct features in all. Executors turn texts into feature counts, the driver sees those counts only.
For two classes the softmax of an average is the logistic function of an average of one number per feature, so scoring
sends BUCKETS numbers to the tasks (a fixed size) and reads every whole text once, with no shuffle.

Edge cases: null and empty texts hold the constant feature only and get its score. Rows with a null label or id are not
learned from. If a class has no labelled row, the share of good labels (0.5 without any) is every score. Repeated rows get
the same score; an empty table gives an empty result. Labels, language, source and id are no inputs of a score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactscope.llm import common

#: Rows of the hashed table, length of a vector, characters of the n-grams.
BUCKETS, WIDTH, GRAMS = 1 << 17, 16, (2, 3, 4)
#: Bounds of the training sample: labelled rows, and distinct features of all of them.
SAMPLE, FEATURES = 6_000, 12_000_000
#: Least passes over the sample and least steps in all, first learning rate; documents with at least this score are kept.
EPOCHS, STEPS, RATE, KEEP = 5, 20_000, 0.5, 0.7

_AGAIN = np.uint64(1)
_BLANKS = np.zeros(0x110000, bool)
_BLANKS[[0x20, *range(9, 14), 0x85, 0xA0, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x3000]] = True


def features(text: str | None) -> np.ndarray:
    """The bucket of every feature of the whole text, with repetitions; the last is the constant one."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    constant = np.zeros(1, np.int32)
    blank = _BLANKS[np.minimum(points, 0x10FFFF)]
    inside = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(inside == -1), np.flatnonzero(inside == 1)
    if not len(starts):
        return constant
    plain = np.where(blank, np.uint32(0x20), points)
    padded = np.concatenate([[np.uint32(0x20)], plain, [np.uint32(0x20)]]).astype(np.uint64)
    sums = common.prefix_hashes((padded + np.uint64(1)) * np.uint64(0xA0761D6478BD642F))
    _, back = common._powers(len(sums))
    gap = np.concatenate([[0], np.cumsum(np.concatenate([[True], blank, [True]]))])
    words = (sums[ends + 1] - sums[starts + 1]) * back[starts + 1] + np.uint64(97)
    words[1:][words[1:] == words[:-1]] = _AGAIN
    out = [words]
    for size in GRAMS:
        if len(padded) >= size:
            # no blank but at the ends
            whole = gap[size - 1 : len(padded)] - gap[1 : len(padded) - size + 2] == 0
            hashes = (sums[size:] - sums[:-size]) * back[: len(padded) - size + 1] + np.uint64(size)
            out.append(hashes[whole])
    return np.concatenate([constant, (common.mixed(np.concatenate(out)) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts = [], []
        for text in batch["text"]:
            found, n = np.unique(features(text.as_py()), return_counts=True)
            ids.append(found.astype(np.int32).tobytes())
            counts.append(n.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch["place"], batch["good"], pa.array(ids, pa.binary()), pa.array(counts, pa.binary())],
            names=["place", "good", "ids", "counts"],
        )


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """One number per bucket: the score of a document is the logistic function of their average over its features."""
    good = sum(y for *_, y in examples)
    if good in (0, len(examples)):
        share = good / len(examples) if examples else 0.5
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.full(BUCKETS, np.log(share / (1 - share)))
    r = np.random.default_rng(5)
    vectors = r.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    output = np.zeros((2, WIDTH), np.float32)
    epochs = max(EPOCHS, -(-STEPS // len(examples)))
    left, total = 0, epochs * len(examples)
    for _ in range(epochs):
        for k in r.permutation(len(examples)):
            ids, counts, y = examples[k]
            weights = (counts / counts.sum()).astype(np.float32)
            rate = RATE * (1 - left / total)
            left += 1
            hidden = weights @ vectors[ids]
            scores = output @ hidden
            odds = np.exp(scores - scores.max())
            error = -odds / odds.sum()
            error[y] += 1
            back = error @ output
            output += rate * np.outer(error, hidden)
            vectors[ids] += (rate * weights)[:, None] * back
    return (vectors @ (output[1] - output[0])).astype(np.float64)


def train(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Learns from labels (doc_id, quality), one row per id (the largest label, the smallest text), on a bounded sample."""
    marks = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("good"))
    place = F.xxhash64("doc_id")
    sample = marks.select(F.col("doc_id").alias("id"), "good", place.alias("place")).orderBy("place", "id").limit(SAMPLE)
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("id"))
    chosen = chosen.groupBy("place", "good", "doc_id").agg(F.min("text").alias("text")).select("place", "good", "text")
    counted = chosen.mapInArrow(_counted, "place long, good int, ids binary, counts binary")
    examples, size = [], 0
    for row in counted.orderBy("place").toLocalIterator():
        size += len(row.ids) // 4
        if size > FEATURES:
            break
        examples.append((np.frombuffer(row.ids, np.int32), np.frombuffer(row.counts, np.int32), int(row.good > 0)))
    return fit(examples)


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = held.value
        for batch in batches:
            sums = [numbers[features(text.as_py())].mean() for text in batch["_text"]]
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -60, 60)))
            names = [n for n in batch.schema.names if n != "_text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch[n] for n in names), pa.array(scores, pa.float64())], names=[*names, "_score"]
            )

    return run


def scored(docs: DataFrame, numbers: np.ndarray, columns: list[str]) -> DataFrame:
    """The columns of docs and, as the last one, the score of its text, named score_."""
    held = docs.sparkSession.sparkContext.broadcast(numbers.astype(np.float32))
    rows = docs.select(*[F.col(c).alias(f"c{k}") for k, c in enumerate(columns)], F.col("text").alias("_text"))
    kinds = [f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(columns)]
    out = rows.mapInArrow(_scored(held), ", ".join([*kinds, "_score double"]))
    return out.toDF(*columns, "score_")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, score (higher: label 1 likelier), predicted (1 from KEEP on)."""
    rows = scored(docs, train(docs, labels), ["doc_id"]).withColumnRenamed("score_", "score")
    return rows.withColumn("predicted", (F.col("score") >= KEEP).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that score KEEP or more; columns as they are."""
    return scored(docs, train(docs, labels), docs.columns).filter(F.col("score_") >= KEEP).select(*docs.columns)
