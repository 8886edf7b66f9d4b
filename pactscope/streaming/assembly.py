"""K3: messages assembled from a stream of chat events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from pactscope.operators.chat import message_citations, message_text
from pactscope.streaming.runs import finite_keyed_run, shared_folder

OUTPUT = "msg_id long, status string, text string, n_chunks int, clause_ids array<string>"

#: Minutes without an event after which a message that never ended is given out and an ended one is forgotten.
IDLE_MINUTES = 10

_EVENT = StructType([
    StructField("seq", IntegerType()), StructField("type", StringType()), StructField("content", StringType()),
    StructField("clause_ids", ArrayType(StringType())),
])
_ENDED = StructType([StructField("ended", BooleanType())])


def _message(events: list[tuple]) -> tuple[str, int, list[str]]:
    """Text, number of chunks and cited clauses (each once, by first appearance) of a message's events."""
    ordered = sorted(events, key=lambda e: e[0])
    chunks = [content or "" for _, kind, content, _ in ordered if kind == "token"]
    cited = dict.fromkeys(i for _, kind, _, ids in ordered if kind == "citation" for i in (ids if ids is not None else ()))
    return "".join(chunks), len(chunks), list(cited)


class MessageAssembly(StatefulProcessor):
    """Per message: its events until "done" comes, then only that it ended; both go after a time without events.

    status of what is given out: ``done`` a message that ended, ``unfinished`` one that went silent, ``late`` a single
    chunk or citation that came after the end and is kept aside.
    """

    def __init__(self, idle_minutes: float = IDLE_MINUTES):
        self.idle = int(idle_minutes * 60_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", _EVENT)
        self.ended = handle.getValueState("ended", _ENDED)

    def _row(self, key, status: str, events: list[tuple]) -> tuple:
        return (key[0], status, *_message(events))

    def _wait(self, now: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(now + self.idle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        columns = (arrived[c] for c in ("seq", "type", "content", "clause_ids"))
        new = [(int(s), t, c, None if ids is None else list(ids)) for s, t, c, ids in zip(*columns, strict=True)]
        out = []
        said = [e for e in new if e[1] != "done"]
        if self.ended.exists():
            out = [self._row(key, "late", [e]) for e in said]
        elif len(said) < len(new):
            held = [tuple(e) for e in self.events.get()] if self.events.exists() else []
            out = [self._row(key, "done", held + said)]
            self.events.clear()
            self.ended.update((True,))
        else:
            self.events.appendList(said)
        self._wait(timerValues.getCurrentProcessingTimeInMs())
        yield pd.DataFrame(out, columns=["msg_id", "status", "text", "n_chunks", "clause_ids"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.events.exists():
            out = [self._row(key, "unfinished", [tuple(e) for e in self.events.get()])]
        self.events.clear()
        self.ended.clear()
        yield pd.DataFrame(out, columns=["msg_id", "status", "text", "n_chunks", "clause_ids"])

    def close(self) -> None:
        pass


def assemble_messages(events: DataFrame, idle_minutes: float = IDLE_MINUTES) -> DataFrame:
    """Stream of (msg_id, seq, type, content, clause_ids) to a stream of messages (see ``MessageAssembly``)."""
    return events.groupBy("msg_id").transformWithStateInPandas(
        statefulProcessor=MessageAssembly(idle_minutes), outputStructType=OUTPUT, outputMode="Append", timeMode="ProcessingTime"
    )


def assemble_batch(events: DataFrame) -> DataFrame:
    """The same over all events of a table: every message that ended."""
    tokens = events.where(F.col("type") == "token").select("msg_id", "seq", F.coalesce("content", F.lit("")).alias("chunk"))
    citations = events.where(F.col("type") == "citation").select("msg_id", "seq", "clause_ids")
    ended = events.where(F.col("type") == "done").select("msg_id").distinct()
    both = ended.join(message_text(tokens), "msg_id", "left").join(message_citations(citations), "msg_id", "left")
    return both.select(
        "msg_id", F.lit("done").alias("status"), F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("clause_ids", F.array().cast("array<string>")).alias("clause_ids"),
    )


def run_to_table(spark: SparkSession, events: DataFrame, idle_minutes: float = IDLE_MINUTES) -> DataFrame:
    """Drives the stream over all input there is and returns what it wrote."""
    folder = shared_folder(spark, "assembly")
    with finite_keyed_run(spark):
        run = (
            assemble_messages(events, idle_minutes).writeStream.format("parquet").outputMode("append")
            .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).start()
        )
        run.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{folder}/out")
