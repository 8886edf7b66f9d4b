"""SentencePiece by lattice against a plain Viterbi; rollups against plain sums."""

import random
import time
import zlib
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece

from pactscope.llm import counts, pieces, queries
from tests.llm.fixtures import SF

PATH = public_tokenizers.path("piece_bpe_32k.model")


def viterbi(model, text):
    """The best path over the whole text at once, position by position; ties go to the longer last piece."""
    text = "▁" + text.replace(" ", "▁")
    usable = {
        model.id_to_piece(i): (model.get_score(i), i) for i in range(model.get_piece_size())
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))
    }
    worst = min(s for s, _ in usable.values()) - pieces.UNKNOWN
    best = [(0.0, 0, [])]
    for end in range(1, len(text) + 1):
        options = []
        for begin in range(max(0, end - 16), end):
            score, ids = usable.get(text[begin:end], (None, None))
            if score is None and end - begin == 1:
                score, ids = worst, None
            if score is not None:
                octets = [ids] if ids is not None else [model.piece_to_id(f"<0x{x:02X}>") for x in text[begin:end].encode()]
                options.append((best[begin][0] + score, -begin, best[begin][2] + octets))
        best.append(max(options, key=lambda o: o[:2]))
    return best[-1][2]


def test_encode_and_decode(spark):
    r = random.Random(3)
    atoms = ["the", "ing", " ", "  ", "\n", "x", "É", "漢", "😀", "Zürich", "2024", ",", "▁", "\x00", "tion", " of", "\t"]
    texts = [None, "", " ", "   ", "a", "hello world"] + ["".join(r.choice(atoms) for _ in range(r.randint(1, 12))) for _ in range(150)]
    texts += ["ab" * 300, "漢字x" * 400, "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789+/漢é😀") for _ in range(3_000))]
    rows = [(i if i else None, t, "x") for i, t in enumerate(texts)]
    table = pieces.piece_table(spark, PATH)
    df = spark.createDataFrame([*rows, rows[5]], "k long, text string, word string").repartition(3)
    encoded = pieces.encode(df, table, ["k"])
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    got = {x.k: x.ids for x in encoded.collect()}
    assert encoded.count() == len(rows) + 1
    for k, text, _ in rows:
        assert got[k] == (viterbi(model, text) if text else []), repr(text)
    for frequent in (0, 5):
        assert {x.k: x.ids for x in pieces.encode(df, table, ["k"], frequent).collect()} == got
    for x in pieces.decode(encoded, table, ["k"]).collect():
        assert x.text == (texts[x.k or 0] or "").replace("▁", " ")
    assert pieces.encode(df.limit(0), table, ["k"]).collect() == []


def test_long_text_without_blanks(spark):
    """Some ten thousand characters in one word, known and unknown ones: as the plain Viterbi, in linear time."""
    r = random.Random(5)
    model, table = sentencepiece.SentencePieceProcessor(model_file=PATH), pieces.piece_table(spark, PATH)
    text = "".join(r.choice("ABCDEFabcdefghijklmnopqrstuvwxyz0123456789+/漢é") for _ in range(60_000))
    got, seconds = {}, {}
    for n in (30_000, 60_000):
        df, before = spark.createDataFrame([(1, text[:n])], "k long, text string"), time.time()
        got[n] = pieces.encode(df, table, ["k"]).first().ids
        seconds[n] = time.time() - before
    assert seconds[60_000] < 2.5 * seconds[30_000] + 2
    assert got[30_000] == viterbi(model, text[:30_000])


def test_rare_words_stay_beside_their_text(spark, monkeypatch):
    """No text, word or edge is shuffled, and words of some blocks have the paths of the plain Viterbi."""
    monkeypatch.setattr(pieces, "BLOCK", 40)
    r = random.Random(7)
    words = ["".join(r.choice("abcdeinorst漢é😀") for _ in range(r.choice([1, 3, 8, 39, 40, 41, 200]))) for _ in range(300)]
    table = pieces.piece_table(spark, PATH)
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    found = pieces.best_paths(pieces.pa.array(["▁" + w for w in words]), pieces.Pieces(table.collect())).to_pylist()
    assert found == [viterbi(model, w) for w in words]
    texts = spark.createDataFrame([(k, w + " " + w) for k, w in enumerate(words)], "k long, text string")
    encoded = pieces.encode(texts, table, ["k"], 5)
    assert "Exchange" not in encoded._jdf.queryExecution().executedPlan().toString()
    assert {x.k: x.ids for x in encoded.collect()} == {k: 2 * ids for k, ids in enumerate(found)}


def test_query_encodes_documents(spark):
    """op10 gives one row per document; ids of short ones are those of the plain Viterbi."""
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    got = {r.doc_id: r for r in queries.op10_sentencepiece(spark, SF).collect()}
    assert got.keys() == texts.keys()
    assert all(got[d].round_trip for d, t in texts.items() if "▁" not in (t or ""))
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for d in sorted(texts, key=lambda d: len(texts[d] or ""))[:8]:
        ids = viterbi(model, texts[d]) if texts[d] else []
        assert (got[d].n_pieces, got[d].ids_crc32) == (len(ids), zlib.crc32(",".join(map(str, ids)).encode()))


def test_rollups(spark, tmp_path):
    r = random.Random(4)
    rollups, state = counts.Rollups(spark, f"file://{tmp_path}"), {}
    schema = "doc_id long, version string, op string, source string, lang string, tokens long, seq int, docs string"
    for batch in range(1, 5):
        changes = []
        for _ in range(60):
            op = r.choice(["insert", "revise", "delete"])
            changes.append((r.choice([None, *range(25)]), r.choice(["a", "b"]), op, r.choice(["s", None]), r.choice(["en", None]),
                            r.choice([None, *range(9)]), r.randint(0, 3), "x"))
        for c in sorted(changes, key=lambda c: (c[6], c[5] or 0, c[3] is not None, c[4] is not None, c[2])):
            state[c[0], c[1]] = None if c[2] == "delete" else (c[3], c[4], c[5] or 0)
        df = spark.createDataFrame(changes, schema)
        assert rollups.commit(batch, df)
        assert not rollups.commit(batch, df)
    want = {}
    for (_, version), found in state.items():
        if found:
            docs, tokens = want.get((found[0], found[1], version), (0, 0))
            want[found[0], found[1], version] = docs + 1, tokens + found[2]
    assert {(x.source, x.lang, x.version): (x.docs, x.tokens) for x in rollups.totals().collect()} == want
    with pytest.raises(ValueError):
        counts.Rollups(spark, f"file://{tmp_path}").commit(0, df)
    assert rollups.commit(9, df.limit(0))
    empty = counts.Rollups(spark, f"file://{tmp_path}/none")
    assert empty.totals().collect() == []


def test_counts_of_repeated_and_null_ids(spark, tmp_path):
    """Every row counts as in the SQL: ids that repeat with other texts, equal rows, rows without an id."""
    docs = [(1, "a b", "en", "s"), (1, "c d e", "en", "s"), (1, "a b", "en", "s"), (1, "a b", "de", None), (None, "x y", "en", "s"),
            (None, "z", "en", "s"), (None, "z", "en", "s"), (2, "p q", "en", "s"), (2, "r", "en", "t"), (3, None, "en", "t"), (3, "", "en", "t")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(1, 1, 0), (2, 0, 1), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = con.execute(queries.ORACLE["op6_token_counts"]).fetchall()
    assert Counter(map(tuple, queries.op6_token_counts(spark, str(tmp_path)).collect())) == Counter(want)
