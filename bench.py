"""Wall time of headline queries; prints one JSON line.

    BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from queries import registry
from tablemend.session import build_session

HEADLINE = [
    "shipments_page", "search_any_column", "kpi", "ingestion_metrics", "geo_enrich", "new_shipments",
    "routes", "impute_weight_median", "constraint_checks", "process_manifest", "row_profiles",
    "dataset_profile_docs", "repeating_pattern_docs", "data_start_scores", "cycle_scores_docs",
    "group_scored", "sparse_merge_docs", "rechunk_stream", "reconstruct_cycle", "table_scores",
    "best_shifts", "reconstruct_customers", "reconstruct_orders",
]


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    shown = os.dup(1)
    os.dup2(2, 1)  # keep stdout to the one line
    spark = build_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    known = registry()
    took: dict[str, float] = {}
    for name in names:
        runs = []
        # one warm-up on the smallest data compiles the plan's code
        known[name].run(spark, os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")).write.format("noop").mode(
            "overwrite"
        ).save()
        for _ in range(repeats):
            start = time.perf_counter()
            known[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[name] = round(statistics.median(runs), 3)
        print(f"{name:30s} {took[name]:8.2f}", file=sys.stderr, flush=True)
    line = json.dumps(
        {
            "metric": "headline_queries_total",
            "value": round(sum(took.values()), 3),
            "unit": "sec",
            "queries": took,
            "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            "cpus": cpus,
            "spark": spark.version,
        }
    )
    os.write(shown, (line + "\n").encode())
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
