"""Benchmark the headline queries.

Runs each query of ``HEADLINE`` on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` (default 8), writing to the
``noop`` sink so the whole plan executes without collecting to the driver.
One warm-up run, then the median of ``$BENCH_RUNS`` (default 3) timed runs.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wharf.plans.registry import QUERIES  # noqa: E402
from wharf.session import build_session  # noqa: E402

HEADLINE = {
    "q_latest_per_key": "D-01_latest_per_key",
    "q_snapshot_asof": "D-02_snapshot_asof",
    "q_validate_rows": "D-03_validate_rows",
    "q_upsert_ods": "D-06_upsert_ods",
    "q_anchor_select": "D-13_anchor_select",
    "q_allocate": "D-14_allocate",
    "q_opportunity_mart": "D-15_opportunity_mart",
    "q_mom_flag": "D-10_mom_flag",
    "q_data_as_of": "D-16_data_as_of",
    "q_agent_daily_feed": "M-14_AgentDaily_feed",
}


def run_once(spark, name: str, sf: str) -> float:
    t0 = time.perf_counter()
    QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(f"local[{cpus}]", app="wharf-bench")
    times = {}
    for short, name in HEADLINE.items():
        run_once(spark, name, sf)
        times[short] = round(statistics.median(run_once(spark, name, sf) for _ in range(runs)), 3)
    spark.stop()
    sf_label = sf.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_median_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf_label, "cpus": int(cpus), "runs": runs}))


if __name__ == "__main__":
    main()
