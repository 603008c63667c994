"""Benchmark: one JSON line with the seconds of each headline query.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores.  Each
query is built and run in full (noop sink) after one warm-up query; times include plan building.
"""

from __future__ import annotations

import json
import os
import re
import time

from factloom.plans.queries import QUERIES
from factloom.session import local_session

HEADLINE = [
    "render_text", "preference_pairs", "train_eval_split", "render_chat", "length_budget_documents",
    "extract_rule_based", "extract_plugged_model", "recover_json", "schema_validate", "typed_projection",
    "model_metrics", "metrics_by_scenario", "entity_coverage", "fact_examples", "run_summary", "series_downsample",
    "latency_histogram", "inflight_requests", "latency_percentiles", "request_metrics_windowed",
]
# Rows the query makes or reads per order, for rows per second.
RATES = {"render_text": 1, "preference_pairs": 1, "recover_json": 5, "schema_validate": 5, "model_metrics": 5}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    QUERIES["scenario_composition"](spark, folder).collect()
    orders = spark.read.parquet(f"{folder}/orders.parquet").count()
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else None,
                "rows_per_second": {n: round(k * orders / seconds[n]) for n, k in RATES.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
