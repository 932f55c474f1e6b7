"""Headline queries, timed: prints one JSON line.

Each query is run once to warm up and then timed over a few runs; all its
output columns are computed and thrown away (noop sink).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from logweave import plans, session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))

HEADLINE = (
    "asa_parse_quality", "asa_fields", "nginx_fields", "nginx_status", "cef_extension", "rfc5424_envelope", "json_logs_k", "mixed_sources",
    "scrape_samples", "exporter_counters", "attribution", "attribution_by_agent", "delivery_counters", "counter_deltas",
    "config_leaves", "config_audit", "edge_flow_percent", "ranked_nodes",
    "recent_500_search", "text_search", "facets",
    "inventory", "restarts", "flap_episodes", "config_rollout", "fleet_overview", "health_timeline",
    "route_fanout", "hec_envelope",
)


def main() -> None:
    spark = session.build("bench", master=f"local[{CPUS}]", shuffle_partitions=int(CPUS), **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    jobs, _ = plans.load()
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = None
        for run in range(RUNS + 1):
            start = time.perf_counter()
            jobs[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if run:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    lines = jobs["asa_fields"](spark, SF_DIR).count()
    sf = os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf else None,
        "rows_per_sec": {n: round(lines / times[n]) for n in ("asa_fields", "nginx_fields")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
