"""Helpers that the training-data operators share: cutting lineage, size-checked broadcasts, hashing of bytes in numpy."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of two or three numbers that a broadcast may hold; beyond it the other side is shuffled.
BROADCAST_ROWS = 1_000_000

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where it is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pactscope-"))
    return str(jsc.getCheckpointDir().get()).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder: lost executors cost no recomputation, drawn ids stay as they are."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read again: as cut, for long tables of numbers, which columns compress."""
    file = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(file)
    return df.sparkSession.read.schema(df.schema).parquet(file)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df (already cut, narrow) with a broadcast hint if it has so few rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def numbered(keys: DataFrame, name: str = "name", rows: int | None = None) -> DataFrame:
    """Distinct rows of keys, sorted over all partitions, each with an integer name in that order (cut).

    rows: about so many in a partition; names are numbered in a row within one.
    """
    columns, keys = keys.columns, keys.distinct()
    parts = [max(1, keys.count() // rows)] if rows else []
    ordered = keys.repartitionByRange(*parts, *columns).sortWithinPartitions(*columns)
    ordered = ordered.coalesce(*parts) if rows else ordered
    return cut(ordered.withColumn(name, F.monotonically_increasing_id()))


def text_bytes(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (wraps around by design)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed 64-bit numbers from a seed."""
    return mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * _STEP)


_ODD = np.uint64(0xD1342543DE82EF95)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


_POWERS = np.ones(1, np.uint64)
_BACK = np.ones(1, np.uint64)
_VALUES = stream(11, 256) | np.uint64(1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse modulo 2^64, at least n of each."""
    global _POWERS, _BACK
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1 << 16)
        for name, base in (("_POWERS", int(_ODD)), ("_BACK", _inverse(int(_ODD)))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            globals()[name] = np.multiply.accumulate(steps)
    return _POWERS, _BACK


def prefix_hashes(values: np.ndarray) -> np.ndarray:
    """Running sums of value * multiplier^position: span_hashes reads the hash of any span from two of them."""
    powers, _ = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers[: len(values)], out=sums[1:])
    return sums


def byte_hashes(data: np.ndarray) -> np.ndarray:
    return prefix_hashes(_VALUES[data])


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span [start, end): equal for equal contents, wherever they stand."""
    _, back = _powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _STEP)


#: Bytes that separate words: the blank and 0x09 to 0x0D.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text, as byte positions."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_BLANK[data]
    turns = np.diff(inside)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
