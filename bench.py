"""Seconds per headline query: one warm-up, then the median of three runs into a sink that discards rows.

Prints one JSON line. Environment: BENCH_SF_DIR (tables), BENCH_CPUS (local cores), BENCH_RUNS (timed runs).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "trend_page_views", "trend_revenue", "hourly_rollup", "overview_totals", "overview_series", "top_pages", "top_country", "live_visitors", "session_records", "session_assignment",
    "funnel_steps", "funnel_breakdown", "funnel_compare", "conversion_series", "journey_paths", "journey_transitions", "retention_on_or_after", "cohort_events_and", "chart_breakdown_series",
    "chart_formula", "profile_metrics", "profiles_by_device", "session_summaries", "events_page", "realtime_coordinates", "insight_cards", "shopper_features", "shopper_scores",
    "ingest_events", "network_lookup", "conversion_payloads",
]


def main() -> None:
    sf_dir, cpus, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
             .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.log.level", "ERROR").getOrCreate())
    from tidemark.plans import QUERIES
    from tidemark.plans.registry import BUILD_SECONDS

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds, builds = {}, {}
    for name in HEADLINE:
        once(name)  # builds the stored tables the query reads, if no query before it did
        builds |= {f"build_{table}": round(took, 3) for table, took in BUILD_SECONDS.items()}
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    # Sessionising and storing events is work of its own, done once for all reports: it counts as lines of the total.
    seconds |= builds
    print(json.dumps({"metric": "headline queries and builds of stored tables, total of medians", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
