"""Token ids in length-delimited binary records, with an offset index beside each file.

Record file: the magic bytes, one byte with the size of an id (2 or 4), then one record per document:
    length of the data (unsigned 64 bits) | masked checksum of those 8 bytes | data | masked checksum of the data
with ids as little-endian unsigned numbers. Checksums are CRC-32, rotated and offset as in MASK, so that data which holds
checksums itself stays well checked. Index file: one fixed-size entry per record (id of the document, whether it has one,
offset of the record, number of ids), so that any record can be read alone, in any order.

Documents are dealt to files by ranges of doc_id and sorted in them; equal ids are parted by a hash of the text, so that a
hot id doesn't fill one file. Tasks write under names of their own and return them; only names in the manifest, which is
written before anything is read, belong to the data set, so a task that ran twice leaves nothing behind in it. Files go to
the shared folder through any file system that pyarrow opens by URI.

Encoding works on columns: the joined bytes of some texts are cut before blanks that a character follows which is surely not
blank, and around single line ends inside text, where the byte-level pre-tokenizer always cuts as well. The pieces become a
dictionary column; each different piece is encoded once and kept for later blocks, and ids are gathered by the pieces' places.
Texts that hold a special token's string are one piece.

Edge cases: null counts as empty, and every document gets the end id. Null ids come first. Rows that repeat an id have a
record each. An empty table gives an empty manifest and result. Other columns of the input are not looked at.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pactscope.llm.common import cut

#: Fixed values of the file format.
MAGIC, MASK = b"PSREC1\n", 0xA282EAD8
INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("offset", "<u8"), ("n", "<u4")])

#: Bytes of text for one file, bytes after which a task starts a new one; bytes of text that a worker encodes at a time (or
#: one text), pieces and ids of pieces that it keeps.
FILE_TEXT, FILE_BYTES, BLOCK, KEPT, KEPT_IDS = 24 << 20, 128 << 20, 8 << 20, 600_000, 8 << 20

#: Pieces that are encoded in one text.
JOINED = 100

#: First bytes of characters that are surely not blank (some characters that start with C2, E1, E2 or E3 are), and bytes of
#: printed ASCII characters.
_PLAIN, _PRINTED = np.zeros(256, bool), np.zeros(256, bool)
_PRINTED[0x21:0x7F] = True
_PLAIN[0x21:0x7F] = _PLAIN[0xC3:0xE1] = _PLAIN[0xE4:0xF5] = True

#: Whether a piece starts with a blank and a character that is surely not blank.
_LEADS = re.compile("^ [!-~\u00c0-\u0fff\u4000-\U0010ffff]").match


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def framed(data: bytes) -> bytes:
    length = len(data).to_bytes(8, "little")
    return b"".join((length, masked(length).to_bytes(4, "little"), data, masked(data).to_bytes(4, "little")))


def unframed(blob: memoryview, at: int) -> memoryview:
    """The data of the record at an offset; both checksums are compared."""
    length = bytes(blob[at : at + 8])
    end = at + 12 + int.from_bytes(length, "little")
    if masked(length) != int.from_bytes(blob[at + 8 : at + 12], "little"):
        raise ValueError(f"damaged length at {at}")
    data = blob[at + 12 : end]
    if len(blob) < end + 4 or masked(data) != int.from_bytes(blob[end : end + 4], "little"):
        raise ValueError(f"damaged record at {at}")
    return data


def _spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the texts in their joined bytes, and those bytes; nothing is copied but the offsets."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return offsets - offsets[0], data[offsets[0] : offsets[-1]]


class Encoder:
    """Ids of whole texts from the JSON of a byte-level tokenizer, a column of texts at a time."""

    def __init__(self, json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(json)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.lengths[list(vocabulary.values())] = [len(token) for token in vocabulary]
        self._forget()

    def _forget(self) -> None:
        """Empties the table of pieces: the place of each, and where its ids start and how many they are in one array."""
        self.places: dict[str, int] = {}
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.kind)

    def _placed(self, pieces: list[str]) -> np.ndarray:
        """Places of different pieces in the table; new ones are encoded and added."""
        if len(self.places) > KEPT or len(self.flat) > KEPT_IDS:
            self._forget()
        new = [p for p in pieces if p not in self.places]
        if new:
            leading = list(filter(_LEADS, new))
            new = leading + list(filterfalse(_LEADS, new))
            sizes, ids = self._encoded(new, len(leading))
            self.places.update(zip(new, range(len(self.places), len(self.places) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, np.cumsum(sizes) - sizes + len(self.flat)])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, ids])
        return np.fromiter(map(self.places.__getitem__, pieces), np.int64, len(pieces))

    def _encoded(self, pieces: list[str], leading: int) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each piece has, and the ids. The first pieces, those that lead, are encoded JOINED to a text: the
        pre-tokenizer cuts where they meet, and the bytes that tokens stand for tell where each ends."""
        texts = ["".join(pieces[k : min(k + JOINED, leading)]) for k in range(0, leading, JOINED)]
        if any(token in text for token in self.special for text in texts):
            return self._encoded(pieces, 0)
        found = [e.ids for e in self.tokenizer.encode_batch_fast(texts + pieces[leading:], add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(chain.from_iterable(found), self.kind, sizes.sum())
        if not leading:
            return sizes, ids
        within = np.cumsum(self.lengths[ids[: sizes[: len(texts)].sum()]])
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in pieces[:leading]), np.int64, leading))
        last = np.minimum(np.searchsorted(within, ends), len(within) - 1)
        if len(within) != last[-1] + 1 or (within[last] != ends).any():
            return self._encoded(pieces, 0)
        return np.concatenate([np.diff(last, prepend=-1), sizes[len(texts) :]]), ids

    def _piece_starts(self, texts: pa.Array, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where the pieces of the texts start in their joined bytes."""
        filled = offsets[:-1] < offsets[1:]
        firsts, lasts = offsets[:-1][filled], offsets[1:][filled] - 1
        followed = np.zeros(len(data), bool)
        followed[:-1] = _PLAIN[data[1:]]
        followed[lasts] = False
        line = (data == 10) & followed
        line[1:] &= _PRINTED[data[:-1]]
        line[firsts] = False
        begins = ((data == 32) & followed) | line
        begins[1:] |= line[:-1]
        whole = np.zeros(len(texts), bool)
        for token in self.special:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        for k in np.flatnonzero(whole):
            begins[offsets[k] : offsets[k + 1]] = False
        begins[firsts] = True
        return np.flatnonzero(begins)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (no nulls) in a row, and where those of each text end."""
        offsets, data = _spans(texts)
        if not len(data):
            return np.zeros(0, self.kind), np.zeros(len(texts), np.int64)
        starts = self._piece_starts(texts, offsets, data)
        held = [None, pa.py_buffer(np.append(starts, len(data))), pa.py_buffer(data)]
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), held).dictionary_encode()
        known = self._placed(pieces.dictionary.cast(pa.large_string()).to_pylist())
        places = known[pieces.indices.to_numpy()]
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.starts[places] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return ids, np.append(0, ends)[np.searchsorted(starts, offsets[1:])]

    def encode(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


_ENCODERS: dict[int, Encoder] = {}


def _encoder(json: str) -> Encoder:
    key = zlib.crc32(json.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(json)
    return _ENCODERS[key]


def _opened(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, pa.Array]]:
    """doc_id and text (null: empty) of rows whose texts have about BLOCK bytes, or of one row."""
    for batch in batches:
        ids, texts = batch["doc_id"], pc.fill_null(batch["text"], "")
        before = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64) // BLOCK
        edges = np.flatnonzero(np.diff(before, prepend=-1, append=-1)) if len(before) else np.zeros(0, np.int64)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            yield {"doc_id": ids.slice(a, b - a), "text": texts.slice(a, b - a)}


def _written(held, folder: str, end_id: int):
    """Writes the rows of a task, in their order; one manifest row per file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(held.value)
        files, path = _opened(folder)
        end = np.array([end_id], encoder.kind).tobytes()
        size = len(end)
        part, number, out, index = TaskContext.get().partitionId(), 0, None, []

        def closed():
            out.close()
            with files.open_output_stream(f"{path}/{name}.idx") as side:
                side.write(np.array(index, INDEX).tobytes())
            row = {"part": part, "number": number, "name": name, "docs": len(index), "ids": sum(r[3] for r in index)}
            return pa.RecordBatch.from_pylist([row])

        for block in _blocks(batches):
            ids, ends = encoder.encode_column(block["text"])
            begins = [0, *ends[:-1].tolist()]
            for doc_id, a, b in zip(block["doc_id"].to_pylist(), begins, ends.tolist(), strict=True):
                if out is None:
                    name = f"part-{part:06d}-{number:04d}-{uuid.uuid4().hex}"
                    out, index, offset = files.open_output_stream(f"{path}/{name}.rec"), [], len(MAGIC) + 1
                    out.write(MAGIC + bytes([size]))
                data = framed(ids[a:b].tobytes() + end)
                out.write(data)
                index.append((doc_id or 0, doc_id is not None, offset, b - a + 1))
                offset += len(data)
                if offset > FILE_BYTES:
                    yield closed()
                    out, number = None, number + 1
        if out is not None:
            yield closed()

    return run


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encodes docs (doc_id, text) with the tokenizer file, appends end_id to each, writes them below folder (a URI).

    Returns the manifest, one row per file in ascending doc_id order: folder, name, docs, ids, start (ids in files before).
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as file:
        held = spark.sparkContext.broadcast(file.read())
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{os.path.abspath(folder)}"
    files, path = _opened(folder)
    files.create_dir(path, recursive=True)
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = texts.withColumn("tie", F.xxhash64("text")).repartitionByRange(max(1, -(-size // FILE_TEXT)), "doc_id", "tie")
    written = ordered.sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(
        _written(held, folder, end_id), "part long, number long, name string, docs long, ids long"
    )
    manifest = cut(written)
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("ids").over(before), F.lit(0))
    return manifest.select(F.lit(folder).alias("folder"), "name", "docs", "ids", start.alias("start"))


def sequences(folder: str, name: str, seed: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids before it in the file, ids) of one file: in file order, or shuffled by a seed through the index."""
    files, path = _opened(folder)
    with files.open_input_file(f"{path}/{name}.idx") as side:
        index = np.frombuffer(side.read(), INDEX)
    with files.open_input_file(f"{path}/{name}.rec") as file:
        blob = memoryview(file.read())
    if bytes(blob[: len(MAGIC)]) != MAGIC:
        raise ValueError(f"{name} is no record file")
    kind = f"<u{blob[len(MAGIC)]}"
    starts = np.cumsum(index["n"].astype(np.int64)) - index["n"]
    order = range(len(index)) if seed is None else np.random.default_rng(seed).permutation(len(index))
    for k in order:
        ids = np.frombuffer(unframed(blob, int(index["offset"][k])), kind)
        if len(ids) != index["n"][k]:
            raise ValueError(f"{name} and its index differ at record {k}")
        yield (int(index["doc_id"][k]) if index["known"][k] else None), int(starts[k]), ids


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = [
                (doc_id, row["start"] + at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                for doc_id, at, ids in sequences(row["folder"], row["name"])
            ]
            columns = zip(*found, strict=True)
            names = ["doc_id", "start", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)


def read_digests(manifest: DataFrame) -> DataFrame:
    """One row per record of the files: doc_id, start (ids of all records before), n_tokens, ids_crc32."""
    files = manifest.repartition(max(1, manifest.count()))
    return files.mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
