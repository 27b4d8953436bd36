"""Headline queries at one scale factor; prints one JSON line.

Each query runs once to warm up and then ``BENCH_RUNS`` times; its time is the
median of building the plan and writing all rows to the no-op sink.  The first,
cold run is reported beside it.
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import sys
import time

from usageloom.catalog import load
from usageloom.session import build_session

HEADLINE = (
    "a28_overview_kpis",        # overview
    "k01_top_prompts",          # period
    "a25_trend_distribution",   # trend
    "a18_rebuild_by_cause",     # cache
    "a21_cost_quantiles",       # distribution
    "a13_startup_context",      # start-up context view
    "a02_daily",
    "a01_prompt_cost",
    "w01_cache_identity",
    "t03_merge_requests",
    "t10_causal_attribution",
    "t13_redact",
    "r02_pace_landing",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(cores, int(cores))
    queries = load().QUERIES

    def once(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    warm, cold = {}, {}
    for name in HEADLINE:
        cold[name] = round(once(name), 3)
        warm[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(name, cold[name], warm[name], file=sys.stderr, flush=True)
    rows = spark.read.parquet(f"{folder}/events.parquet").count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(warm.values()), 3), "unit": "sec", "queries": warm,
        "cold": cold, "requests": rows,
        "rows_per_sec": {n: round(rows / t) for n, t in warm.items()},
        "sf": pathlib.Path(folder).name.removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
