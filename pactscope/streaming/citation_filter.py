"""K1: hides citation markers in streams of chat chunks, also where a marker is cut across chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StringType, StructField, StructType

from pactscope.functions.lexicon import CITATION
from pactscope.streaming.runs import finite_keyed_run, shared_folder

OUTPUT = "msg_id long, seq int, content string"

# How a marker opens, and the length from which an open one is taken for plain text
OPENING = "[CITE:"
LONGEST_OPEN = 45

_MARKER = re.compile(CITATION)


def pass_on(held: str, chunk: str) -> tuple[str, str]:
    """What can be shown after ``chunk`` arrives, and what has to be held back."""
    text, removed = _MARKER.subn("", held + chunk)
    while removed:
        text, removed = _MARKER.subn("", text)
    cut = text.rfind("[")
    tail = text[cut:] if cut >= 0 else ""
    is_open = tail.startswith(OPENING) or OPENING.startswith(tail)
    return (text[:cut], tail) if tail and is_open and len(tail) < LONGEST_OPEN else (text, "")


def last_words(held: str) -> str:
    """What of the held text is shown when the message ends: an unfinished marker is not."""
    return re.sub(r"\[CITE?\Z", "", re.sub(r"\[CITE:[^\]]*\Z", "", _MARKER.sub("", held)))


class CitationFilter(StatefulProcessor):
    """Per message, the only state is a tail shorter than 45 characters."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", StructType([StructField("tail", StringType())]))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """State is asked for once, and written only where it changes: each call goes to the JVM and back."""
        before = self.tail.get()
        held, ended = before[0] if before else "", False
        for row in sorted(rows, key=lambda row: row["seq"]):
            out, held = pass_on(held, row["chunk"])
            if row["last"]:
                out, held, ended = out + last_words(held), "", True
            if out:
                yield Row(msg_id=key[0], seq=row["seq"], content=out)
        if not ended:
            self.tail.update((held,))
        elif before:
            self.tail.clear()

    def close(self) -> None:
        pass


def filter_citation_markers(chunks: DataFrame) -> DataFrame:
    """Stream of (msg_id, seq, chunk, last) to a stream of (msg_id, seq, content)."""
    return chunks.groupBy("msg_id").transformWithState(
        statefulProcessor=CitationFilter(), outputStructType=OUTPUT, outputMode="Append", timeMode="None"
    )


def run_to_table(spark: SparkSession, chunks: DataFrame) -> DataFrame:
    """Drives the stream over all input there is and returns what it wrote."""
    folder = shared_folder(spark, "citation-filter")
    with finite_keyed_run(spark):
        run = (
            filter_citation_markers(chunks).writeStream.format("parquet").outputMode("append")
            .option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True).start()
        )
        run.awaitTermination()
    return spark.read.schema(OUTPUT).parquet(f"{folder}/out")
