"""Headline queries on one data directory; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from checks.registry import QUERIES
from checks.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = [
    "top_projects_week", "project_model_mix", "usage_summary", "rate_summary", "token_bins_daily",
    "meter_timeline", "quota_cycle", "burn_day_bins", "model_stats", "context_carry",
    "dedup_calls", "ledger_events", "redact_paths",
]


def main() -> None:
    spark = local_session()
    spark.range(1).count()
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
