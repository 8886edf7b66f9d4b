"""Approximate nearest neighbours by cosine, from randomly rotated one-bit codes.

Every unit vector is rotated at random into CODE_TIMES as many dimensions (D, a multiple of 64) and keeps one bit of each
coordinate: the nearest corner of a cube. With two correction scalars (the inner product of vector and corner, and the number
of ones) the inner product with a query is estimated without bias from packed bits: the rotated query is rounded to BITS-bit
numbers, and each of its bit planes is met with the code by AND and popcount. The error is below
    MARGIN * sqrt((1 - c^2) / c^2 / (D - 1)),   c the inner product of vector and corner,
but for a fraction of a percent of pairs. Vectors whose upper bound reaches a query's k-th best are reranked in double
precision on the original vectors; so far the k-th best is that of the reranked ones, at first of the lower bounds.

Codes need no training. All rows are indexed and all are scanned: the data may have no clusters, and then lists of a coarse
quantizer lose neighbours. The stated query set meets all rows in blocks of WAVE queries, which are sent to the tasks (a fixed
size); a task holds the best k of each query of the block and sends only those.

Equal vectors are one entry with their k + 1 smallest ids (a window that Spark limits before the shuffle), so that a very
common vector is neither scanned nor reranked more than once. Vectors of different lengths are never neighbours.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components take no part. Rows that repeat id and
vector count once. With fewer than k candidates all are returned. An empty table, or one without queries, gives an empty
result. Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactscope.llm.common import cut

CODE_TIMES, BITS, MARGIN = 4, 4, 3.0
#: Queries of a block, queries met with a batch at once.
WAVE, AT_ONCE = 16_384, 128


def rotation(d: int) -> np.ndarray:
    """A fixed random map of d dimensions into D, keeping lengths and angles."""
    wide = -(-CODE_TIMES * d // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(17).standard_normal((wide, d)))
    return q * np.sign(np.diag(r))


def coded(vectors: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed bits, inner product with the corner, number of ones of each vector."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ turn.T
    bits = turned > 0
    corner = np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])
    return np.packbits(bits, axis=1).view(np.uint64), corner, bits.sum(axis=1)


def rounded(queries: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bit planes of the rounded rotated queries (plane, query, word), lowest value, step, and sum of their coordinates."""
    turned = (queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ turn.T
    low = turned.min(axis=1, keepdims=True)
    step = (turned.max(axis=1, keepdims=True) - low) / (2**BITS - 1)
    whole = np.rint((turned - low) / np.where(step > 0, step, 1)).astype(np.uint8)
    planes = np.stack([np.packbits((whole >> k) & 1, axis=1).view(np.uint64) for k in range(BITS)])
    return planes, low[:, 0], step[:, 0], turned.sum(axis=1)


def estimated(codes: tuple, queries: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines (query, vector) and the error bound of each vector."""
    bits, corner, ones = codes
    planes, low, step, total = queries
    wide = bits.shape[1] * 64
    met = np.zeros((planes.shape[1], len(bits)), np.float64)
    for k, plane in enumerate(planes):
        both = np.zeros(met.shape, np.uint16)
        for w in range(bits.shape[1]):
            both += np.bitwise_count(plane[:, w, None] & bits[None, :, w])
        met += both * float(1 << k)
    inner = step[:, None] * met + low[:, None] * ones[None, :]
    estimate = (2 * inner - total[:, None]) / np.sqrt(wide) / corner[None, :]
    return estimate, MARGIN * np.sqrt(np.maximum(0, 1 - corner**2) / corner**2 / (wide - 1))


def exact(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosines of paired rows in double precision."""
    return (vectors * queries).sum(axis=1) / (np.sqrt((vectors * vectors).sum(axis=1)) * np.sqrt((queries * queries).sum(axis=1)))


class Best:
    """The k best of each query of a block so far: scores, smallest ids, and all ids of the entry."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries.astype(np.float64), k
        self.turn = rotation(queries.shape[1])
        self.scores = np.full((len(queries), k), -np.inf)
        self.firsts = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.ids = np.full((len(queries), k), None, object)

    def see(self, vectors: np.ndarray, ids: list[list[int]]) -> None:
        vectors = vectors.astype(np.float64)
        codes = coded(vectors, self.turn)
        first = np.array([x[0] for x in ids], np.int64)
        for at in range(0, len(self.queries), AT_ONCE):
            some = slice(at, at + AT_ONCE)
            estimate, error = estimated(codes, rounded(self.queries[some], self.turn))
            least = self.scores[some, -1]
            if len(ids) >= self.k:
                lower = np.partition(estimate - error, len(ids) - self.k, axis=1)[:, len(ids) - self.k]
                least = np.maximum(least, lower)
            q, x = np.nonzero(estimate + error >= least[:, None])
            scores = np.concatenate([
                exact(vectors[x[i : i + 65536]], self.queries[q[i : i + 65536] + at]) for i in range(0, len(x), 65536)
            ] or [np.zeros(0)])
            keep = scores >= self.scores[q + at, -1]
            self._merge(q[keep] + at, x[keep], scores[keep], first, ids, some)

    def _merge(self, q, x, scores, first, ids, some) -> None:
        held_q, held_k = np.nonzero(self.scores[some] > -np.inf)
        held_q = held_q + some.start
        every_q = np.concatenate([held_q, q])
        every_s = np.concatenate([self.scores[held_q, held_k], scores])
        every_f = np.concatenate([self.firsts[held_q, held_k], first[x]])
        source = np.concatenate([-1 - held_k, x])
        order = np.lexsort((every_f, -every_s, every_q))
        every_q, every_s, every_f, source = every_q[order], every_s[order], every_f[order], source[order]
        begins = np.r_[True, every_q[1:] != every_q[:-1]]
        rank = np.arange(len(every_q)) - np.maximum.accumulate(np.where(begins, np.arange(len(every_q)), 0))
        keep = rank < self.k
        every_q, every_s, every_f, source, rank = every_q[keep], every_s[keep], every_f[keep], source[keep], rank[keep]
        moved = [self.ids[a, -1 - b] if b < 0 else ids[b] for a, b in zip(every_q.tolist(), source.tolist(), strict=True)]
        self.scores[every_q, rank], self.firsts[every_q, rank] = every_s, every_f
        for a, b, value in zip(every_q.tolist(), rank.tolist(), moved, strict=True):
            self.ids[a, b] = value


def _searched(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, queries = held.value
        best = None
        for batch in batches:
            if batch.num_rows:
                best = best or Best(queries, k)
                flat = batch["vector"].flatten().to_numpy(zero_copy_only=False)
                best.see(flat.reshape(batch.num_rows, -1), batch["ids"].to_pylist())
        if best is not None:
            q, rank = np.nonzero(best.scores > -np.inf)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers[q]), pa.array(best.scores[q, rank]), pa.array(best.ids[q, rank].tolist(), pa.list_(pa.int64()))],
                names=["query", "score", "ids"],
            )

    return run


def nearest(vectors: DataFrame, query: object, k: int = 5) -> DataFrame:
    """The k nearest rows by cosine of every row for which `query` (a condition on vec_id) holds, itself left out.

    vectors: vec_id, embedding. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller vec_id.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter("vec_id is not null").withColumnRenamed("vector", "embedding").filter(
        F.col("embedding").isNotNull() & sound & F.exists("embedding", lambda x: x != 0)
    )
    same = Window.partitionBy("embedding").orderBy("vec_id")
    few = rows.distinct().withColumn("row", F.row_number().over(same)).filter(F.col("row") <= k + 1)
    entries = few.groupBy("embedding").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    entries = cut(entries.withColumnRenamed("embedding", "vector").withColumn("length", F.size("vector")))
    asked = cut(rows.filter(query).distinct())
    wanted = asked.select("embedding").distinct().withColumn("length", F.size("embedding"))
    wanted = cut(wanted.withColumn("query", F.monotonically_increasing_id()))

    found = None
    for (length,) in wanted.select("length").distinct().orderBy("length").collect():
        of_length = entries.filter(F.col("length") == length).select("ids", "vector")
        block: list = []
        total = wanted.filter(F.col("length") == length).count()
        for seen, row in enumerate(wanted.filter(F.col("length") == length).toLocalIterator(), 1):
            block.append((row.query, row.embedding))
            if len(block) == WAVE or seen == total:
                sent = (np.array([b[0] for b in block], np.int64), np.array([b[1] for b in block], np.float64))
                held = vectors.sparkSession.sparkContext.broadcast(sent)
                part = of_length.mapInArrow(_searched(held, k + 1), "query long, score double, ids array<long>")
                found = part if found is None else found.unionByName(part)
                block = []
    if found is None:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("ids")[0])
    top = found.withColumn("row", F.row_number().over(order)).filter(F.col("row") <= k + 1)
    top = cut(top.groupBy("query").agg(F.collect_list(F.struct("score", "ids")).alias("near")))
    own = asked.join(wanted.select("embedding", "query"), "embedding").select("vec_id", "query").join(top, "query")
    each = F.flatten(F.transform("near", lambda e: F.transform(e["ids"], lambda i: F.struct((-e["score"]).alias("far"), i.alias("id")))))
    others = F.slice(F.array_sort(F.filter(each, lambda e: e["id"] != F.col("vec_id"))), 1, k)
    listed = own.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("pos", "e"))
    return listed.select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("e.id").alias("vec_id"), (-F.col("e.far")).alias("score")
    )
