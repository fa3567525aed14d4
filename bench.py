"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidegate.plans.queries import QUERIES
from tidegate.session import build_session

HEADLINE = [
    "p2_page_tags", "p4_page_text", "p6_page_inputs", "p7_page_links", "p9_page_features",
    "j1_threat_feed_join", "j2_filter_list_join", "j3_blocklist_join", "j5_typosquat_join",
    "j9_session_attribution", "j11_verdict_as_of", "r10_evaluate", "r13_rule_results", "host_decisions",
    "f10_should_forward", "a1_session_stats", "t5_latest_analyses_per_rule", "w1_previous_urls",
    "w4_session_rotation", "q1_traffic_quality",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            started = time.time()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - started)
        seconds[name] = round(runs[-1], 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))


if __name__ == "__main__":
    main()
