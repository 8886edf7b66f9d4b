"""Record files: round trips, checksums, shuffled reads, and encoding against the plain tokenizer."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pactscope.llm import records
from tests.llm.fixtures import SCHEMA, rows

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)


def plain(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_encoder_against_the_tokenizer():
    r = random.Random(2)
    atoms = [" ", "  ", "\n", "\n\n", "\t", "\r\n", " ", " ", "\x1c", "\x0b", "a", "the", "word,", "don't", "'s", "42", "é漢",
             "!!", "<|endoftext|>", "x" * 50, "​", "\x00", "　", "\x85"]
    texts = ["", " ", "\n"] + ["".join(r.choice(atoms) for _ in range(r.randint(1, 25))) for _ in range(4000)]
    encoder = records.Encoder(open(PATH, encoding="utf-8").read())
    for at in range(0, len(texts), 700):
        part = texts[at : at + 700]
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(part)] == [plain(t) for t in part]


def test_table_of_pieces_is_emptied_and_filled_again(monkeypatch):
    monkeypatch.setattr(records, "KEPT", 5)
    encoder = records.Encoder(open(PATH, encoding="utf-8").read())
    texts = ["one two three four five six seven", "", "x" * 30000, "é " * 2000 + "漢字 " * 500, "two  three\n four\nfive ", " a"]
    for _ in range(3):
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.encode(texts)] == [plain(t) for t in texts]


def test_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "FILE_TEXT", 20_000)
    monkeypatch.setattr(records, "BLOCK", 500)
    table = rows(n=40)
    docs = spark.createDataFrame(table, SCHEMA).repartition(4)
    manifest = records.write_records(docs, str(tmp_path), PATH, 2)
    files = manifest.collect()
    assert len(files) > 2
    want = sorted(((d is not None, d or 0), [*plain(t), 2]) for d, t, *_ in table)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in records.read_digests(manifest).collect()) == sorted(
        (*d, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for d, ids in want
    )
    stored = [(d, f.start + at, ids.tolist()) for f in files for d, at, ids in records.sequences(f.folder, f.name)]
    assert [d for d, *_ in stored] == [d if known else None for (known, d), _ in want]
    assert [s for _, s, _ in stored] == np.cumsum([0, *(len(ids) for *_, ids in stored)])[:-1].tolist()
    mixed = [(d, f.start + at, ids.tolist()) for f in files for d, at, ids in records.sequences(f.folder, f.name, seed=4)]
    assert mixed != stored
    assert sorted(mixed, key=lambda x: x[1]) == stored


def test_damage_is_found():
    blob = records.framed(b"some ids")
    assert bytes(records.unframed(memoryview(blob), 0)) == b"some ids"
    for k in range(len(blob)):
        bad = bytearray(blob)
        bad[k] ^= 1
        with pytest.raises(ValueError):
            records.unframed(memoryview(bytes(bad)), 0)


def test_empty_table(spark, tmp_path):
    manifest = records.write_records(spark.createDataFrame([], SCHEMA), str(tmp_path), PATH, 2)
    assert records.read_digests(manifest).collect() == []
