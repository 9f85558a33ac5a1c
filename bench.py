"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Each query is executed in full through the ``noop`` sink (every row is
produced, nothing is collected to the driver). Times are wall-clock seconds
per query, the best of ``BENCH_REPEAT`` (default 2) runs after a warm-up --
this machine's run-to-run noise is about 10 %; ``value`` is their sum.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "flagship_coverage",
    "topk_dense",
    "adherence_matrix",
    "similarity_matrix",
    "score_profile",
    "sentences",
    "word_count_profile",
    "term_frequency",
    "phrase_frequency",
    "term_frequency_by_group",
    "topk_sparse",
    "compare_strategies",
    "doc_parameter_matrix",
    "parameter_frequency",
    "coverage_by_doc",
    "distribution_by_dim",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE

    from framescope.plans.catalog import QUERIES
    from framescope.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="framescope-bench")
    # warm-up: JVM, Parquet reader and the Python workers of the vector scorer
    QUERIES["word_count_profile"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["topk_dense"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    times: dict[str, float] = {}
    for _ in range(repeat):
        for name in names:
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            t = round(time.perf_counter() - t0, 3)
            times[name] = min(times.get(name, t), t)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": int(cpus), "repeat": repeat}))


if __name__ == "__main__":
    main()
