"""Token counts by source, language and tokenizer version, kept as rollups of signed changes.

A batch of changes is committed under a number. Changes insert, delete or revise the count of a document under a tokenizer
version; what a deletion or revision takes away is read from a ledger of the latest state of every document and version, so
totals stay right whatever the change says. A batch adds one small table of signed totals, summed before the shuffle, and one
slice of the ledger; totals are the sums over all committed batches. Nothing is rewritten: cost follows the changes and the
ledger's keys, texts are never shuffled.

Commits are idempotent. The ledger slice is written first and the totals last, in folders named by the batch; the marker that
Spark leaves after a complete write is the commit. A batch with a marker is not applied again, one without is overwritten.
Batches are numbered upwards; a number below the last committed one that isn't committed itself is refused.

Documents may repeat a doc_id or have none: each row is a key of its own in the ledger (doc_id and a digest of text, source and
language), and rows that are equal in all of these are one key with their number.

Edge cases: null sources, languages and ids are keys like others. Of several changes to one document's row and version in a batch
the one with the largest seq counts (then the largest count, source, language). A null count is 0. Deleting or revising what
isn't there changes nothing or inserts it. An empty batch commits nothing but its marker. Extra columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "doc_id long, row binary, version string, source string, lang string, tokens long, docs long, batch int"
TOTALS = "source string, lang string, version string, docs long, tokens long, batch int"


class Rollups:
    """The rollups below one shared folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _committed(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/totals")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        found = [s.getPath() for s in files.listStatus(path)]
        done = [p for p in found if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().split("=")[1]) for p in done)

    def _slices(self, name: str, batches: list[int], schema: str) -> DataFrame:
        if not batches:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.folder}/{name}/batch={b}" for b in batches]
        return self.spark.read.schema(schema).option("basePath", f"{self.folder}/{name}").parquet(*paths)

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Applies changes (doc_id, version, op, source, lang, tokens, seq); False if the batch was committed before.

        With columns row (binary) and copies, a change is about so many equal rows of one doc_id; without, about its one row.
        """
        done = self._committed()
        if batch in done:
            return False
        if done and batch < done[-1]:
            raise ValueError(f"batch {batch} comes after batch {done[-1]}")
        if "row" not in changes.columns:
            changes = changes.withColumns({"row": F.lit(None).cast("binary"), "copies": F.lit(1)})
        copies = F.col("copies").cast("long")
        state = F.struct("seq", F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), "source", "lang", "op", copies.alias("docs"))
        latest = changes.groupBy("doc_id", "row", "version").agg(F.max(state).alias("new"))
        key = F.col("doc_id").eqNullSafe(F.col("k_id")) & F.col("row").eqNullSafe(F.col("k_row"))
        key &= F.col("version").eqNullSafe(F.col("k_version"))
        old = self._latest(done).select(
            F.col("doc_id").alias("k_id"), F.col("row").alias("k_row"), F.col("version").alias("k_version"), "old"
        )
        gone = F.col("new.op") == "delete"
        slice_ = latest.select(
            "doc_id", "row", "version", "new.source", "new.lang",
            F.when(gone, F.lit(0)).otherwise(F.col("new.tokens") * F.col("new.docs")).cast("long").alias("tokens"),
            F.when(gone, F.lit(0)).otherwise(F.col("new.docs")).cast("long").alias("docs"),
        )
        slice_.write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")
        written = self.spark.read.parquet(f"{self.folder}/ledger/batch={batch}")
        added = written.filter("docs > 0").select("source", "lang", "version", "docs", "tokens")
        before = written.select("doc_id", "row", "version").join(old, key).filter("old.docs > 0")
        taken = before.select("old.source", "old.lang", "version", (-F.col("old.docs")).alias("docs"), (-F.col("old.tokens")).alias("tokens"))
        totals = added.unionByName(taken).groupBy("source", "lang", "version").agg(
            F.sum("docs").cast("long").alias("docs"), F.sum("tokens").cast("long").alias("tokens")
        )
        totals.write.mode("overwrite").parquet(f"{self.folder}/totals/batch={batch}")
        return True

    def _latest(self, batches: list[int]) -> DataFrame:
        """The state of every document's rows and version after the batches."""
        rows = self._slices("ledger", batches, LEDGER)
        state = F.struct("source", "lang", "tokens", "docs")
        return rows.groupBy("doc_id", "row", "version").agg(F.max_by(state, F.col("batch")).alias("old"))

    def totals(self) -> DataFrame:
        """source, lang, version, docs, tokens: the sums over all committed batches, without groups that are empty."""
        summed = self._slices("totals", self._committed(), TOTALS).groupBy("source", "lang", "version").agg(
            F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")
        )
        return summed.filter("docs <> 0 or tokens <> 0")


#: Two versions of a rule-based tokenizer: words; letters, digits and single other characters.
PATTERNS = {"words-1": r"[^\x20\x09-\x0D]+", "words-2": r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9\x20\x09-\x0D]"}


def token_count(version: str, column: str = "text") -> Column:
    """Tokens of the whole text."""
    return F.coalesce(F.regexp_count(column, F.lit(PATTERNS[version])), F.lit(0)).cast("long")


def row_key() -> Column:
    """A digest of what counts of a row of documents: text, source and language."""
    about = F.to_json(F.struct("source", "lang"))
    return F.unhex(F.sha2(F.concat(F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256), about), 256))


def counted(docs: DataFrame, version: str, op: str = "insert") -> DataFrame:
    """A change for each row of docs under a tokenizer version, equal rows of one doc_id as one change with their number."""
    rows = docs.select("doc_id", row_key().alias("row"), "source", "lang", token_count(version).alias("tokens"))
    rows = rows.groupBy("doc_id", "row").agg(
        *(F.first(c).alias(c) for c in ("source", "lang", "tokens")), F.count(F.lit(1)).alias("copies")
    )
    return rows.select("doc_id", "row", F.lit(version).alias("version"), F.lit(op).alias("op"), "source", "lang", "tokens",
                       F.lit(0).alias("seq"), "copies")
