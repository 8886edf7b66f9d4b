"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pactscope.plans import catalogue  # noqa: E402
from pactscope.session import local_session  # noqa: E402

HEADLINE = [
    "a1_least_fair_contracts",
    "r1_pattern_flags",
    "r18_evaluate_clause",
    "r19_evaluate_documents",
    "x4_propagate_mitigation",
    "a10_portfolio_rollup",
    "w1_rank_risk_clauses",
    "w2_retrieve_top_k",
    "w5_keyword_context",
    "g2_paragraph_windows",
    "g7_number_clauses",
    "s3_assemble_full_text",
    "g9_pack_batches",
    "x5_merge_verdicts",
    "s13_consultation_brief",
    "w10_last_turns",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "pactscope-bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalogue.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
