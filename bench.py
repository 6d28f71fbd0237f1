"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores. Each query runs once to
warm up and then BENCH_RUNS times (3 by default); the median counts. A run writes the
whole result to the no-op sink, so every row and column is produced.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from dossier.plans.catalog import QUERIES
from dossier.session import local_session

HEADLINE = [
    "counts_by_dimension",
    "heatmap",
    "sector_summary",
    "top_groups",
    "unique_postings",
    "coverage",
    "costliest",
    "taxonomy",
    "raw_key",
    "parse_usd",
    "strip_html",
    "merge_edges",
    "resolve_edges",
    "cross_sector_groups",
    "only_in_described",
    "intake_status",
    "corroborate",
    "route",
    "vector_topk_by_type",
    "entity_footprint",
    "expand_hits",
    "neighbour_context",
    "graph_counts",
    "taxonomy_members",
    "contained_names",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores=str(cpus), partitions=cpus, memory="12g")
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
                "runs": runs,
            }
        )
    )


if __name__ == "__main__":
    main()
