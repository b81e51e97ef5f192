"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "normalize_entries", "normalize_entries_plain", "normalize_entries_eventviewer", "correlate_entries", "correlate_entries_crowded", "error_summaries",
    "incidents_and_health", "component_match", "representative_evidence", "investigate", "log_facts",
    "openapi_contributions", "analyze_code",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from checks import load_all
    from checks.compare import session
    from checks.core import ranked
    from checks.knowledge import incident_entries

    queries = load_all().QUERIES
    spark = session(cpus)
    spark.sparkContext.setLogLevel("ERROR")
    start = time.time()
    ranked(spark, sf_dir)
    incident_entries(spark, sf_dir)
    times = {"stage_entries_to_incidents": round(time.time() - start, 3)}
    for name in HEADLINE:
        t = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
