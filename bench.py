"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the cores.
Each query runs once to warm up and is then timed once, writing its full result
to a sink that discards it.  Landing the pages is timed as a query of its own;
the others read the landed pages, as the engine would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from harvestline.queries import all_queries  # noqa: E402
from harvestline.session import local_session  # noqa: E402

HEADLINE = (
    "extract_records",
    "walk_cursor",
    "walk_page_number",
    "rate_audit",
    "resume_filter_rfc3339",
    "high_water",
    "incremental_runs",
    "shape_observe",
    "drift_verdict",
    "typed_rows",
    "dead_letters",
    "digest_dedup",
    "batch_ledger",
    "status_fold",
    "failure_streak",
    "fingerprint_changes",
    "event_log",
    "metric_counters",
    "duration_histogram",
)


def run_once(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cpus)
    known = all_queries()
    times = {"land_pages": round(run_once(known["land_pages"], spark, sf_dir), 3)}
    for name in HEADLINE:
        run_once(known[name], spark, sf_dir)
        times[name] = round(run_once(known[name], spark, sf_dir), 3)
    events = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    runs = spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    rates = {
        "shape_observation_records_per_sec": events / times["shape_observe"],
        "resume_and_high_water_records_per_sec": events / times["high_water"],
        "digest_dedup_records_per_sec": events / times["digest_dedup"],
        "ledger_fold_runs_per_sec": runs / times["status_fold"],
    }
    print(
        json.dumps(
            {
                "metric": "headline_total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "rates": {k: round(v) for k, v in rates.items()},
                "cpus": cpus,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
