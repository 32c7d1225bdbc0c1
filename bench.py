"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)

from checks.registry import run  # noqa: E402
from eventloom.session import build_session  # noqa: E402

HEADLINE = (
    "detect_spikes", "correlate_events", "detect_event_pair_patterns", "detect_numeric_anomalies", "transaction",
    "detect_patterns", "detect_raw_prefixes", "detect_cert_anomalies", "severity_summary", "host_error_ranking",
    "detect_slow_queries", "detect_http_errors", "detect_socket_backlog", "detect_thread_count_growth",
    "correlate_latency_load", "saturation_verdict", "extract_timestamps", "build_timeline", "group_by_host",
    "area_timeline", "query_area_stats", "latest_run_status", "tag_alerts", "findings_counts",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        runs = []
        for _ in range(2):  # the first run pays for code generation
            start = time.perf_counter()
            run(spark, name, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
        print(f"{name} {runs}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
