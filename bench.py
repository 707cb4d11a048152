"""Times the headline queries: one warm-up, then the median of two runs each."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from gleanery.plans.catalogue import load
from gleanery.session import build_session

HEADLINE = [
    "search", "boolean_filter", "sanitize_documents", "dedup_exact", "entities", "dedup_hierarchical", "classify_tier", "top_k", "enrich_by_doi",
    "authority_diff", "upsert_state", "latency_summary", "prisma_funnel", "frequency_tables", "manifest_hash", "rate_windows", "dead_letter",
    "circuit_state", "box_overlaps", "line_clusters", "dedup_fuzzy",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(cpus, "bench")
    registered, _ = load()
    times: dict[str, float] = {}
    for name in names:
        taken = []
        for n in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
            if sum(taken) > 60 and n:
                break
        times[name] = round(statistics.median(taken[1:]), 3)
        print(name, [round(x, 2) for x in taken], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
