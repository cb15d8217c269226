"""Time the headline queries and print one JSON line.

BENCH_SF_DIR chooses the tables, BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import re
import time

from varstrip.plans.catalog import QUERIES
from varstrip.session import local_session

HEADLINE = [
    "tick_drop_reasons",
    "tick_dedup",
    "latest_legs",
    "chain_forwards",
    "expiry_variance",
    "venue_index",
    "outlier_state",
    "blended_index",
    "minute_bars",
    "history_5m",
    "tick_direction",
    "listed_backtest",
    "fitted_backtest",
    "variant_sweep",
    "benchmark_nearest",
    "triggered_orders",
    "position_values",
    "vault_history",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    QUERIES["minute_bars"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM's engines
    took = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline queries, total", "value": total, "unit": "sec", "queries": took, "sf": float(scale.group(1)) if scale else None}))


if __name__ == "__main__":
    main()
