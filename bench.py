"""Benchmark the headline queries; prints ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is built from its DataFrame definition and executed with the
``noop`` sink (the full plan runs, nothing is collected to the driver). One
warm-up pass runs every query once; then each query's time is the median of
``BENCH_REPEATS`` timed runs (default 3).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "q1_evidence_resolved_claims",
    "q2_validated_claims",
    "q3_balanced_evaluation_set",
    "q4_scored_run_fever_eep",
    "q6_report_all",
    "q7_report_fixed",
    "q10_strategy_comparison",
    "x1_x2_page_sentences",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",")

    from factsift.session import get_spark
    from factsift.plans.catalog import QUERIES

    spark = get_spark(f"local[{cpus}]", app="factsift-bench", shuffle_partitions=int(cpus),
                      extra={"spark.driver.memory": "16g"})
    def run(name: str) -> float:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in names:  # warm-up pass over every query (JIT, staged inputs)
        run(name)
    timings = {name: round(statistics.median(run(name) for _ in range(repeats)), 3) for name in names}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else sf_dir
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": int(cpus),
                      "repeats": repeats}))
    spark.stop()


if __name__ == "__main__":
    main()
