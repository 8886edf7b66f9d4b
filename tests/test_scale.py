"""Plans that read the clauses once, and steps that are linear in a contract's size."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from pactscope.functions import walks
from pactscope.operators import batching, score, segment, spans, xref
from pactscope.plans import rule_queries, verdict_queries
from pactscope.sources import corpus

SF = "/root/testdata/sf0.001"


def scans(df, table="orders"):
    return len(re.findall(rf"FileScan parquet.*{table}.parquet", df._jdf.queryExecution().executedPlan().toString()))


def exchanges(df):
    return len(re.findall(r"Exchange hashpartitioning", df._jdf.queryExecution().executedPlan().toString()))


def test_one_scan_of_the_clauses(spark):
    judged = rule_queries.assessed(spark, SF)
    assert scans(judged) == 1
    assert exchanges(judged) == 1  # the one that deals out contracts
    assert scans(score.overall_fairness(judged)) == 1
    assert exchanges(score.overall_fairness(judged)) == 1
    assert scans(verdict_queries.merged(spark, SF)) <= 4  # clauses, and the reviews with what they are made of


def test_clauses_that_are_not_together_meet_by_contract(spark):
    rows = corpus.clauses(spark, SF).repartition(5)
    assert exchanges(xref.evaluate_documents(rows)) <= 3
    a = xref.evaluate_documents(rows).select("doc_id", "idx", "rule")
    b = rule_queries.assessed(spark, SF).select("doc_id", "idx", "rule")
    assert a.exceptAll(b).isEmpty()
    assert b.exceptAll(a).isEmpty()


@pytest.mark.parametrize("name", ["r6_non_risk_assessment", "a5_risk_pages"])
def test_filters_hold_no_copy_of_the_rules(spark, name):
    plan = rule_queries.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "RLIKE" in line]


def test_pattern_flags_are_no_single_method(spark):
    """Whole-stage code of all patterns is one method, larger than the JVM compiles."""
    session = spark.newSession()
    session.conf.set("spark.sql.adaptive.enabled", "false")
    plan = rule_queries.QUERIES["r1_pattern_flags"](session, SF)._jdf.queryExecution().executedPlan().toString()
    tests = [line for line in plan.splitlines() if "RLIKE" in line]
    assert tests and not [line for line in tests if re.search(r"\*\(\d+\)", line)]


def plain_next_fit(sizes, limit):
    begins, used = [], 0
    for i, n in enumerate(sizes):
        if not begins or used + n > limit:
            begins.append(i)
            used = n
        else:
            used += n
    return begins


def plain_compatible(starts, ends):
    kept, last = [], 0
    for i, (s, e) in enumerate(zip(starts, ends)):
        if s >= last:
            kept.append(i)
            last = e
    return kept


def test_walks():
    r = random.Random(4)
    for _ in range(500):
        sizes = [r.choice([0, 1, 2, 5, 30]) for _ in range(r.randint(0, 30))]
        limit = r.randint(0, 12)
        assert walks.next_fit(sizes, limit) == plain_next_fit(sizes, limit)
        spans_ = sorted((r.randint(-1, 20), r.randint(0, 25)) for _ in range(r.randint(0, 20)))
        starts, ends = [s for s, _ in spans_], [e for _, e in spans_]
        assert walks.compatible(starts, ends) == plain_compatible(starts, ends)


def seconds(df):
    best = float("inf")
    for _ in range(3):
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        best = min(best, time.perf_counter() - start)
    return best


def one_contract(spark, n):
    rows = spark.range(n).select(F.lit(1).cast("long").alias("doc_id"), (F.col("id") + 1).cast("int").alias("idx"))
    return rows.withColumns({"title": F.lit("t"), "text": F.repeat(F.lit("word "), (F.col("idx") % 40).cast("int"))})


@pytest.mark.parametrize("step", ["batches", "spans", "windows"])
def test_twice_the_items_take_twice_the_time(spark, step):
    """One contract of very many clauses, spans or paragraphs; a quadratic step would take four times as long."""
    def run(n):
        rows = one_contract(spark, n)
        if step == "batches":
            return batching.pack_batches(rows, 300)
        if step == "spans":
            return spans.non_overlapping_spans(rows.select(
                "doc_id", F.lit(1).alias("page_no"), "idx", (F.col("idx") * 3).alias("start"), (F.col("idx") * 3 + F.col("idx") % 7).alias("end")))
        text = spark.range(1).select(F.lit(1).cast("long").alias("doc_id"), F.repeat(F.lit("two words of five here\n\n"), n).alias("text"))
        return segment.section_rows(text.withColumn("sections", segment.paragraph_windows(F.col("text"))))

    run(1000).count()
    small, large = seconds(run(100_000)), seconds(run(200_000))
    assert large < 2.6 * small + 0.5
