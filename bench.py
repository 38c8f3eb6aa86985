"""Bench: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS] and
print one JSON line.

Each query is fully executed (a ``noop`` write, so every row is produced and
nothing is collected to the driver) once to warm up, then timed; the value is
the sum of the timed runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "label_trend_month",
    "gap_filled_trend",
    "trends_for_query",
    "tfidf",
    "cluster_names",
    "nearest_topics",
    "unpredicted_docs",
    "upsert_latest",
    "name_trends",
    "evaluate_clusters",
    "assign_nearest",
    "ngrams",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from topicscope.plans.registry import QUERIES
    from topicscope.session import local_session

    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, app="topicscope-bench")
    timings: dict[str, float] = {}
    for name in HEADLINE:
        fn = QUERIES[name]
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
        t0 = time.perf_counter()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": sf,
    }))


if __name__ == "__main__":
    main()
