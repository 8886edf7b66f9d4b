"""Streams over several micro-batches: what is kept, what is given out, what a repeated batch changes."""

import json
import os

import pytest
from pyspark.sql import Row

from pactscope.sources import corpus
from pactscope.streaming import assembly, audit, citation_filter, runs

SF = "/root/testdata/sf0.001"
EVENT = "msg_id long, seq int, type string, content string, clause_ids array<string>"


def event(msg, seq, kind, content=None, ids=None):
    return {"msg_id": msg, "seq": seq, "type": kind, "content": content, "clause_ids": ids}


def run_batches(spark, tmp_path, batches, idle_minutes):
    """One file, one micro-batch; the rows given out and the rows of state after each batch."""
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate(batches):
        (source / f"{i:03}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(source / f"{i:03}.json", (1_700_000_000 + 10 * i,) * 2)  # batches go by age
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(source))
    with runs.finite_keyed_run(spark):
        run = (
            assembly.assemble_messages(events, idle_minutes).writeStream.format("parquet").outputMode("append")
            .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
            .trigger(availableNow=True).start()
        )
        run.awaitTermination()
        state = [p["stateOperators"][0]["numRowsTotal"] for p in map(lambda p: json.loads(p.json) if hasattr(p, "json") else p, run.recentProgress)]
    rows = spark.read.schema(assembly.OUTPUT).parquet(str(tmp_path / "out")).collect()
    return [(r.msg_id, r.status, r.text, r.n_chunks, r.clause_ids) for r in rows], state


def test_messages_over_batches(spark, tmp_path):
    batches = [
        [event(1, 1, "token", "b "), event(1, 0, "token", "a "), event(2, 0, "token", "x")],
        [event(1, 2, "citation", None, ["c1", "c2"]), event(1, 3, "citation", None, ["c2", "c3"]), event(1, 5, "done"), event(1, 4, "token", "c")],
        [event(1, 6, "token", "too late"), event(3, 0, "done")],
    ]
    rows, _ = run_batches(spark, tmp_path, batches, 10)
    assert sorted(rows) == [
        (1, "done", "a b c", 3, ["c1", "c2", "c3"]), (1, "late", "too late", 1, []), (3, "done", "", 0, []),
    ]


def test_state_is_bounded(spark, tmp_path):
    """Every batch ends some messages and leaves others open; what went silent is given out and forgotten."""
    batches = [
        [event(1000 * b + m, 0, "token", "w") for m in range(30)] + [event(1000 * b + m, 1, "done") for m in range(15)]
        for b in range(6)
    ]
    rows, state = run_batches(spark, tmp_path, batches, 0)
    kinds = [r[1] for r in rows]
    assert kinds.count("done") == 90
    assert kinds.count("unfinished") >= 60
    assert max(state) <= 2 * min(state[1:3])
    assert state[-1] <= state[1] * 1.5


def test_batch_gives_what_the_stream_gives(spark):
    rows = [event(1, 0, "token", "a"), event(1, 1, "citation", None, ["x"]), event(1, 2, "done"), event(2, 0, "token", "open"), event(3, 0, "done")]
    events = spark.createDataFrame([tuple(r.values()) for r in rows], EVENT)
    got = sorted((r.msg_id, r.status, r.text, r.n_chunks, r.clause_ids) for r in assembly.assemble_batch(events).collect())
    assert got == [(1, "done", "a", 1, ["x"]), (3, "done", "", 0, [])]


@pytest.fixture(scope="module")
def files(spark):
    return corpus.paged_files(spark, SF).where("doc_id < 200").select("doc_id", "file_text")


def test_a_repeated_or_broken_batch_changes_nothing(spark, files, tmp_path):
    folder = str(tmp_path)
    first, second = files.where("doc_id < 100"), files.where("doc_id >= 100")
    audit.commit_batch(first, 0, folder)
    audit.commit_batch(second, 1, folder)
    once = [audit.committed(spark, folder, t).count() for t in ("index", "scores")]
    audit.commit_batch(second, 1, folder)
    # a batch that wrote one table and no marker
    spark.read.parquet(f"{folder}/index/batch=0").write.parquet(f"{folder}/index/batch=2")
    assert [audit.committed(spark, folder, t).count() for t in ("index", "scores")] == once
    assert once[1] == files.count()


def test_the_audit_repeats_no_step(spark, files, tmp_path):
    """Plans after the first read what the steps before wrote, and none of them goes back to the files."""
    plans = []

    def kept(rows, name):
        plans.append(rows._jdf.queryExecution().executedPlan().toString())
        rows.write.parquet(str(tmp_path / name))
        return spark.read.schema(rows.schema).parquet(str(tmp_path / name))

    judged = audit.audit(files, kept)
    plans.append(judged._jdf.queryExecution().executedPlan().toString())
    assert len(plans) == 4
    assert ["orders.parquet" in p for p in plans] == [True, False, False, False]
    once = audit.audit(files)
    assert judged.exceptAll(once).isEmpty()
    assert once.exceptAll(judged).isEmpty()


def test_a_batch_keeps_its_steps(spark, files, tmp_path):
    audit.commit_batch(files, 0, str(tmp_path))
    assert sorted(os.listdir(tmp_path / "steps" / "batch=0")) == ["clauses", "pages", "tiers"]


def test_located_clauses(spark):
    body = "The Client shall pay each invoice within 30 days."
    text = f"1. First Part\n{body}\f2. Second Part\n{body}\n3. Third  Part\n{body}\n"
    rows = audit.located_clauses(spark.createDataFrame([(1, text), (2, "3. Lone\nNothing of note is said in this long line.")], "doc_id long, file_text string"))
    got = {(r.doc_id, r.idx): (r.page_no, r.start_offset, r.end_offset) for r in rows.collect()}
    first, second = len(f"1. First Part\n{body}"), len(f"2. Second Part\n{body}")
    assert got == {
        (1, 1): (1, 0, first), (1, 2): (2, 0, second), (1, 3): (2, second + 1, second + 1 + len(f"3. Third  Part\n{body}")),
        (2, 1): (1, 0, len("3. Lone\nNothing of note is said in this long line.")),
    }


class Tail:
    """The state of one message, with the calls it got."""

    def __init__(self):
        self.value, self.calls = None, []

    def get(self):
        self.calls.append("get")
        return self.value

    def update(self, value):
        self.calls.append("update")
        self.value = value

    def clear(self):
        self.calls.append("clear")
        self.value = None


def test_the_citation_filter_asks_for_state_once():
    def said(seq, chunk, last):
        return Row(msg_id=5, seq=seq, chunk=chunk, last=last)

    step = citation_filter.CitationFilter()
    step.tail = Tail()
    whole = list(step.handleInputRows((5,), iter([said(1, "E:x] b [CITE:", True), said(0, "a [CIT", False)]), None))
    assert whole == [Row(msg_id=5, seq=0, content="a "), Row(msg_id=5, seq=1, content=" b ")]
    assert step.tail.calls == ["get"]
    assert list(step.handleInputRows((5,), iter([said(0, "a [CIT", False)]), None)) == [Row(msg_id=5, seq=0, content="a ")]
    assert list(step.handleInputRows((5,), iter([said(1, "E:x] b", True)]), None)) == [Row(msg_id=5, seq=1, content=" b")]
    assert step.tail.calls == ["get", "get", "update", "get", "clear"]
