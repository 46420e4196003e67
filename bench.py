"""Time the headline queries: one JSON line with warm medians in seconds."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "vcf_allele_counts", "allele_counts", "jsfs_exact", "jsfs_projected", "jsfs_folded", "candidate_pairs_both",
    "graph_options", "projection_retention", "bootstrap_spectra", "bootstrap_summary", "transition_scan",
    "transition_mle", "aic_ranking", "multistart_stability", "library_scan", "classify_direction", "map_edges",
    "source_sink", "recovery_summary", "linked_summary", "threshold_scan", "pareto_minimum", "matched_comparison",
    "method_summary", "release_gates",
)


def main() -> None:
    from driftway.plans.queries import QUERIES
    from driftway.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "driftway-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)  # the first run warms up
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total warm time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
