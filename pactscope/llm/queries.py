"""Registered queries of the training-data operators, each over its whole table, and the DuckDB SQL of some."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pactscope.llm import ann, counts, exact, minhash, packing, periods, pieces, quality, records, repair, simhash, suffix, urls
from pactscope.llm.common import shared_folder
from pactscope.llm.repair_sql import repair_sql
from pactscope.llm.periods_sql import periods_sql
from pactscope.llm.url_sql import template_sql


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learnable_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that may be learned from."""
    return _table(spark, sf_dir, "labels").filter(~_held_out()).select("doc_id", "quality")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = quality.quality_scores(_table(spark, sf_dir, "documents"), learnable_labels(spark, sf_dir))
    return scores.select("doc_id", _held_out().alias("held_out"), "score", "predicted")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op3_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_token_id_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/records-{uuid.uuid4().hex}"
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return records.read_digests(records.write_records(_table(spark, sf_dir, "documents"), folder, tokenizer, end_id=2))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents inserted under one tokenizer version (and that batch sent twice), all under the next version, toxic ones
    deleted, counts of good ones revised by one end mark; the totals after that."""
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    rollups = counts.Rollups(spark, f"{shared_folder(spark)}/counts-{uuid.uuid4().hex}")
    for _ in range(2):
        rollups.commit(1, counts.counted(docs, "words-1"))
    both = counts.counted(docs, "words-2")
    rollups.commit(2, both)
    good = labels.filter("quality = 1").select("doc_id").distinct()
    revised = both.join(good, "doc_id", "left_semi").withColumns({"op": F.lit("revise"), "tokens": F.col("tokens") + 1})
    rollups.commit(3, revised)
    toxic = labels.filter("toxic = 1").select("doc_id").distinct()
    versions = F.explode(F.array(*[F.lit(v) for v in counts.PATTERNS])).alias("version")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    gone = docs.select("doc_id", counts.row_key().alias("row")).join(toxic, "doc_id", "left_semi")
    zeros = [F.lit(0).alias(c) for c in ("tokens", "seq", "copies")]
    deleted = gone.select("doc_id", "row", versions, F.lit("delete").alias("op"), *nothing, *zeros)
    rollups.commit(4, deleted)
    return rollups.totals()


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removal_report(_table(spark, sf_dir, "documents"), length=400)


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by the document whose number ends its path: bad where the document's quality is 0."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    _, path = urls.host_and_path(F.col("url"))
    doc = F.expr("try_cast(regexp_extract(path, '/([0-9]+)[^/]*/?$', 1) as bigint)")
    numbered = pages.select("page_id", path.alias("path")).select("page_id", doc.alias("doc_id"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("bad"))
    judged = urls.judge(pages, numbered.join(labels, "doc_id").select("page_id", "bad"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, encoded and decoded again; the decoded text is held against a digest of the whole text."""
    table = pieces.piece_table(spark, public_tokenizers.path("piece_bpe_32k.model"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = docs.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    back = pieces.decode(pieces.encode(known, table, ["doc_id", "digest"]), table, ["doc_id", "digest"])
    return back.select("doc_id", F.size("ids").cast("long").alias("n_pieces"),
                       F.crc32(F.array_join("ids", ",").cast("binary")).alias("ids_crc32"),
                       (F.unhex(F.sha2(F.col("text").cast("binary"), 256)) == F.col("digest")).alias("round_trip"))


def damaged(turns: DataFrame) -> DataFrame:
    """conversations with a fault in about a quarter of their turns, chosen by a checksum of id and turn."""
    blank = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")])
    told = turns.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                        (F.crc32(name.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", repair.STOPS, "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return told.filter("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def _line_digests(schema: pa.Schema):
    """The digest of each conversation's lines, which come in order; lines are hashed as they pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for conv, line in zip(batch["conv_id"].to_pylist(), batch["line"].to_pylist(), strict=True):
                if state is None or conv != key:
                    if state is not None:
                        out.append({"id": key, "sha": state.hexdigest()})
                    key, state = conv, hashlib.sha256(line)
                else:
                    state.update(b"\n" + line)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([{"id": key, "sha": state.hexdigest()}], schema=schema)

    return run


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged and repaired."""
    turns = _table(spark, sf_dir, "conversations")
    found, repaired = repair.repair(damaged(turns))
    kind = turns.schema["conv_id"].dataType
    lines = repaired.select("conv_id", "number", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "number").select("conv_id", "line")
    schema = pa.schema([("id", to_arrow_type(kind)), ("sha", pa.string())])
    shas = lines.mapInArrow(_line_digests(schema), f"id {kind.simpleString()}, sha string")
    counts_ = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    gaps = F.col("most") - F.col("least") + 1 - F.col("numbers")
    found = found.withColumns({"gaps": gaps, "audit": F.upper("audit")}).select(F.col("conv_id").alias("found_id"), *counts_, "audit")
    ids = turns.select("conv_id").distinct()
    all_ = ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").join(shas, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    return all_.select("conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts_],
                       F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, chosen by the checksum of the id, the last words repeat some of them."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g, words = F.floor(h / 10).cast("long"), F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")

    def tail(w):
        n = F.size(w).cast("long")
        a = (g % n).cast("int")
        p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
        times = F.ceil((n - a) / p).cast("int")
        again = F.slice(F.flatten(F.array_repeat(F.slice(w, a + 1, p), times)), F.lit(1), (n - a).cast("int"))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), again), " "))

    # A list of one list, so that the text is split once.
    changed = F.transform(F.array(words), tail)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, F.coalesce(changed, "text")).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, a tenth of them with planted repeats; its run with the greatest exponent, digests of all runs and of the rest."""
    found = periods.periodic_runs(with_repeats(_table(spark, sf_dir, "documents")))
    # Exponents are compared as fractions: length * other period against other length * period.
    longest = F.aggregate(
        "runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"),
        lambda best, run: F.when(
            best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run,
        ).otherwise(best),
    )
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("run"),
                         F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "run.start", "run.length", "run.period",
                        F.expr("1000 * run.length div run.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=3, radius=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")


_ALL = [op1_quality_classifier, op2_best_fit_packing, op3_approximate_nearest_neighbours, op4_token_id_output, op5_exact_dedup, op6_token_counts, op7_minhash_near_dedup,
        op8_suffix_array_dedup, op9_url_filters, op10_sentencepiece, op11_conversation_repair, op12_periodic_runs, op13_simhash_near_dedup]
QUERIES = {f.__name__: f for f in _ALL}

ORACLE = {
    "op5_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
    "op6_token_counts": rf"""
        WITH marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        counted AS (SELECT d.doc_id, source, lang, version, len(regexp_extract_all(coalesce(text, ''), pattern)) AS tokens
          FROM documents d, (VALUES ('words-1', '{counts.PATTERNS["words-1"]}'), ('words-2', '{counts.PATTERNS["words-2"]}')) v(version, pattern))
        SELECT source, lang, version, count(*) AS docs,
               CAST(sum(tokens + CASE WHEN good AND version = 'words-2' THEN 1 ELSE 0 END) AS BIGINT) AS tokens
        FROM counted LEFT JOIN marks USING (doc_id) WHERE toxic IS NOT TRUE GROUP BY source, lang, version
    """,
    "op9_url_filters": template_sql(),
    "op11_conversation_repair": repair_sql(),
    "op12_periodic_runs": periods_sql(),
}
