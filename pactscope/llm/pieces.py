"""SentencePiece encoding and decoding as relational operations over a lattice.

Texts are normalised as the model says (a blank in front, blanks written as U+2581) and parted before each run of blanks; no
piece of the model crosses such a place, so the best path of a text is the best paths of its words in a row. The words of a
batch are joined to the piece table character by character: from each place the substrings that begin some piece go on, and
those that are pieces give the edges of the lattice; characters without a piece get an edge of the unknown score. The best
scores are folded forward over the places of all words at once, and the best paths back (largest sum of scores; ties go to
the longer last piece). BLOCK characters are taken at a time, and a longer word starts again from as many places before as
the longest piece has characters, so time grows linearly with a word. Unknown characters become their byte pieces.

Words that repeat are counted. The paths of the most frequent ones, FREQUENT at most, each of SHORT characters at most, are
solved once and broadcast: a proven bound. All other words are solved by the same lattice beside their text, once for each
SLICE texts; texts and ids are not shuffled. The piece table is of fixed size: broadcast to encode, one array to decode.

Edge cases: null and empty texts have no pieces and decode to the empty text. U+2581 in a text decodes to a blank. Repeated
rows are encoded each. An empty table gives an empty result. Key columns are passed on as they are, nulls and all; other
columns are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactscope.llm.common import shared_folder

#: Fixed value: what an unknown character scores below the worst piece.
UNKNOWN = 10.0
MARK = "▁"
#: Characters whose edges are held at a time.
BLOCK = 1 << 14
#: Ids of pieces are smaller; unknown characters are numbered from here on by their code points.
UNSEEN = 1 << 22
#: Words whose paths are broadcast, and their longest length in characters.
FREQUENT = 1 << 19
SHORT = 32
#: Texts whose words are looked up together.
SLICE = 2_000
#: Words to a partition when the frequent ones are solved.
TASK_PATHS = 25_000


def piece_table(spark: SparkSession, model: str) -> DataFrame:
    """(piece, id, score, byte) of a SentencePiece model file with byte fallback; byte is null for ordinary pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    rows = [
        (m.id_to_piece(i), i, float(m.get_score(i)), int(m.id_to_piece(i)[3:5], 16) if m.is_byte(i) else None)
        for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i))
    ]
    crossing = [r[0] for r in rows if MARK in r[0].lstrip(MARK)]
    if crossing:
        raise ValueError(f"pieces go on after a blank: {crossing[:3]}")
    return spark.createDataFrame(rows, "piece string, id int, score double, byte int")


def words_of(text: Column) -> Column:
    """The normalised text in parts, each a run of blanks and what follows it; null and empty texts have none."""
    marked = F.replace(F.concat(F.lit(" "), text), F.lit(" "), F.lit(MARK))
    parted = F.replace(F.replace(marked, F.lit(MARK), F.lit(" " + MARK)), F.lit(MARK + " "), F.lit(MARK))
    return F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(F.substring(parted, 2, (1 << 31) - 1), " ")
    )


class Pieces:
    """The piece table as a trie of characters, for the words of a batch.

    Transitions are sorted numbers (node in front, character behind); a walk of one character is an equi-join with them.
    """

    def __init__(self, table: list) -> None:
        normal = [r for r in table if r.byte is None]
        self.first_byte = next(r.id for r in table if r.byte == 0)
        self.longest = max(len(r.piece) for r in normal)
        self.unknown = min(r.score for r in normal) - UNKNOWN
        nodes: dict[str, int] = {"": 0}
        for r in normal:
            for k in range(1, len(r.piece) + 1):
                nodes.setdefault(r.piece[:k], len(nodes))
        steps = sorted((nodes[p[:-1]] << 21 | ord(p[-1]), n) for p, n in nodes.items() if p)
        self.steps, self.nodes = (np.array(c, np.int64) for c in zip(*steps, strict=True))
        self.ids, self.scores = np.full(len(nodes), -1, np.int32), np.full(len(nodes), -np.inf)
        for r in normal:
            self.ids[nodes[r.piece]], self.scores[nodes[r.piece]] = r.id, r.score


def lattice(codes: np.ndarray, left: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """scores, ids [end, longest - n]: the edges of n characters that end with each character, -inf and -1 where there are none.

    left: the characters from each on to the end of its word. An unknown character's id is UNSEEN plus its code point.
    """
    scores = np.full((len(codes), pieces.longest), -np.inf)
    ids = np.full((len(codes), pieces.longest), -1, np.int32)
    at, node = np.arange(len(codes)), np.zeros(len(codes), np.int64)
    for n in range(1, pieces.longest + 1):
        wanted = node << 21 | codes[at + n - 1]
        step = np.searchsorted(pieces.steps, wanted)
        step[step == len(pieces.steps)] = 0
        known = pieces.steps[step] == wanted
        at, node = at[known], pieces.nodes[step[known]]
        scores[at + n - 1, pieces.longest - n] = pieces.scores[node]
        ids[at + n - 1, pieces.longest - n] = pieces.ids[node]
        more = left[at] > n
        at, node = at[more], node[more]
    unseen = ids[:, -1] < 0
    scores[unseen, -1], ids[unseen, -1] = pieces.unknown, UNSEEN + codes[unseen]
    return scores, ids


def _forward(scores: np.ndarray, sizes: np.ndarray, trails: np.ndarray) -> np.ndarray:
    """The column of scores with the last edge of the best path to each character; ties go to the longer edge.

    Words lie one behind the other, longest first. trails: per word, the scores of the places in front of it that an edge can
    reach back to; the scores of the last such places are left there.
    """
    longest, starts = scores.shape[1], np.cumsum(sizes) - sizes
    chosen = np.zeros(len(scores), np.int8 if longest < 128 else np.int32)
    best = np.zeros(len(scores) + longest * len(sizes))
    places = starts + longest * np.arange(len(sizes))
    windows = np.lib.stride_tricks.sliding_window_view(best, longest)
    best[places[:, None] + np.arange(longest)] = trails
    alive = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    for k, words in enumerate(alive.tolist()):
        sums = windows[places[:words] + k] + scores[starts[:words] + k]
        last = sums.argmax(axis=1)
        chosen[starts[:words] + k] = last
        best[places[:words] + k + longest] = sums[np.arange(words), last]
    trails[:] = windows[places + sizes]
    return chosen


def _on_path(lengths: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the best path of a word has an edge that ends with each character, from the lengths of the best edges."""
    ends = np.zeros(len(lengths), bool)
    starts = np.cumsum(sizes) - sizes
    at = starts + sizes - 1
    while len(at):
        ends[at] = True
        at = at - lengths[at]
        on = at >= starts
        at, starts = at[on], starts[on]
    return ends


def _solved(codes: np.ndarray, sizes: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The edges on the best paths of words, longest word first: their ids and how many each word has."""
    ends, ids = np.zeros(len(codes), bool), np.zeros(len(codes), np.int32)
    bounds = np.concatenate(([0], np.cumsum(sizes)))
    word = 0
    while word < len(sizes):
        upto = max(word + 1, int(np.searchsorted(bounds, bounds[word] + BLOCK, side="right")) - 1)
        some, begin, end = sizes[word:upto], bounds[word], bounds[upto]
        lengths = np.zeros(end - begin, np.int32)
        trails = np.full((len(some), pieces.longest), -np.inf)
        trails[:, -1] = 0
        left = np.repeat(bounds[word + 1 : upto + 1], some) - np.arange(begin, end)
        # One word of more than BLOCK characters is taken in several steps.
        for a in range(0, end - begin, BLOCK):
            b, back = min(a + BLOCK, end - begin), min(a, pieces.longest - 1)
            scores, own = lattice(codes[begin + a - back : begin + b], np.minimum(left[a - back : b], b - np.arange(a - back, b)), pieces)
            scores, own = scores[back:], own[back:]
            chosen = _forward(scores, some if len(some) > 1 else np.array([b - a]), trails)
            lengths[a:b], ids[begin + a : begin + b] = pieces.longest - chosen, own[np.arange(b - a), chosen]
        ends[begin:end] = _on_path(lengths, some)
        word = upto
    return ids[ends], np.add.reduceat(ends, bounds[:-1], dtype=np.int64) if len(sizes) else np.zeros(0, np.int64)


def _spelled(ids: np.ndarray, sizes: np.ndarray, first_byte: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and sizes with unknown characters as byte pieces, the UTF-8 bytes of each."""
    unseen = ids >= UNSEEN
    if not unseen.any():
        return ids, sizes
    octets = [chr(c).encode() for c in (ids[unseen] - UNSEEN).tolist()]
    times = np.ones(len(ids), np.int64)
    times[unseen] = [len(o) for o in octets]
    out = np.repeat(ids, times)
    out[np.repeat(unseen, times)] = np.frombuffer(b"".join(octets), np.uint8).astype(np.int32) + first_byte
    ends = np.concatenate(([0], np.cumsum(times)))[np.concatenate(([0], np.cumsum(sizes)))]
    return out, np.diff(ends)


def best_paths(words: pa.Array, pieces: Pieces) -> pa.ListArray:
    """The pieces of the best path of each word, not empty; unknown characters as bytes."""
    texts = [w.decode("utf-8", "replace") for w in words.cast(pa.binary()).to_pylist()]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-sizes, kind="stable")
    codes = np.frombuffer("".join([texts[k] for k in order.tolist()]).encode("utf-32-le"), np.int32)
    ids, counts = _spelled(*_solved(codes, sizes[order], pieces), pieces.first_byte)
    paths = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(ids, pa.int32()))
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return paths.take(pa.array(back))


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch's words and ids are many times its rows: SLICE rows at a time."""
    for batch in batches:
        yield from (batch.slice(k, SLICE) for k in range(0, batch.num_rows, SLICE))


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n: the short words that a batch holds twice or more."""
    for batch in _sliced(batches):
        flat = batch.column("words").flatten()
        counts = flat.filter(pc.less_equal(pc.utf8_length(flat), SHORT)).value_counts()
        counts = counts.filter(pc.greater(counts.field("counts"), 1))
        yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])


def frequent_paths(rows: DataFrame, pieces: Broadcast, most: int) -> pa.Table:
    """word, ids of the most frequent short words, `most` of them at most.

    Words are counted where a batch of texts holds them twice or more, which leaves out the long tail before the shuffle.
    Frequencies are parted on a scale of eighths of powers of two; a part that doesn't fit as a whole stays out.
    """
    spark = rows.sparkSession
    file = f"{shared_folder(spark)}/words-{uuid.uuid4().hex}"
    counted = rows.select("words").mapInArrow(_repeated, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted.write.parquet(file)
    counted, held, least = spark.read.schema("word string, n long").parquet(file), 0, 1 << 30
    counted = counted.select("word", F.floor(8 * F.log2("n")).cast("int").alias("level"))
    for row in counted.groupBy("level").count().orderBy(F.desc("level")).collect():
        if held + row["count"] > most:
            break
        held, least = held + row["count"], row["level"]
    chosen = counted.filter(F.col("level") >= least).select("word").repartition(max(1, held // TASK_PATHS), "word")
    return chosen.mapInArrow(_with_paths(pieces), "word string, ids array<int>").toArrow()


def _with_paths(pieces: Broadcast) -> Callable:
    """word -> word, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("word"), best_paths(batch.column("word"), pieces.value)], ["word", "ids"])

    return run


def _looked_up(known: Broadcast, pieces: Broadcast) -> Callable:
    """held, words -> held, ids; words that aren't known are solved here, once for each slice of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, paths = known.value
        for batch in _sliced(batches):
            lists = batch.column("words")
            bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            at = pc.index_in(flat, value_set=words)
            gone = at.is_null()
            missing = flat.filter(gone).dictionary_encode()
            places = pc.fill_null(at, 0).to_numpy().astype(np.int64)
            places[gone.to_numpy(zero_copy_only=False)] = missing.indices.to_numpy().astype(np.int64) + len(words)
            found = pa.chunked_array([paths, best_paths(missing.dictionary, pieces.value).cast(paths.type)]).combine_chunks().take(pa.array(places))
            ids = pa.ListArray.from_arrays(pa.array(found.offsets.to_numpy()[bounds]), found.values)
            yield pa.RecordBatch.from_arrays([batch.column("held"), ids], ["held", "ids"])

    return run


def encode(texts: DataFrame, pieces: DataFrame, keys: list[str], frequent: int = FREQUENT) -> DataFrame:
    """One row per row of texts: its keys and ids, the piece ids of its whole text.

    frequent: the most words whose paths are broadcast; results don't depend on it.
    """
    spark = texts.sparkSession
    names = [f"key{i}" for i in range(len(keys))]
    held = F.struct(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)])
    rows = texts.select(held.alias("held"), words_of(F.col("text")).alias("words"))
    table = spark.sparkContext.broadcast(Pieces(pieces.collect()))
    paths = frequent_paths(rows, table, frequent)
    known = spark.sparkContext.broadcast(tuple(paths[c].combine_chunks() for c in ("word", "ids")))
    out = T.StructType([rows.schema["held"], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return rows.mapInArrow(_looked_up(known, table), out).select("held.*", "ids").toDF(*keys, "ids")


def decode(encoded: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """One row per row of encoded: its keys, its ids, and text, the text that the ids stand for; no shuffle."""
    spelled = {
        r.id: (r.piece.replace(MARK, " ").encode() if r.byte is None else bytes([r.byte])).hex() for r in pieces.collect()
    }
    digits = F.split(F.lit(",".join(spelled.get(i, "") for i in range(max(spelled) + 1))), ",")
    octets = F.unhex(F.array_join(F.transform("ids", lambda i: F.element_at(digits, i + 1)), ""))
    return encoded.select(*keys, "ids", F.substring(F.decode(octets, "utf-8"), 2, (1 << 31) - 1).alias("text"))
