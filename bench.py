"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import load  # noqa: E402
from ratecraft.session import build_session  # noqa: E402

HEADLINE = [
    "motor_mapping", "motor_rule_join", "keep_on_fail_masks", "coverage_gaps", "health_mapping", "conflict_true_counts", "double_rate_risk", "rate_heatmap", "rule_dashboard", "duplicates_across_groups", "regroup",
    "rate_ingest", "rate_ingest_job", "overlap_scan_summary", "missing_make_model_groups", "first_row_per_group", "lock_checker_search", "grid_summary_pivot", "premium_split_validation", "model_word_overlap",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    conf = {"spark.sql.shuffle.partitions": str(int(cpus) * 2), "spark.driver.memory": "16g", "spark.ui.enabled": "false"}
    spark = build_session(f"local[{cpus}]", "bench", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    timings = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.time() - start, 2)
        print(name, timings[name], file=sys.stderr, flush=True)
    total = round(sum(timings.values()), 2)
    print(json.dumps({"metric": "headline_seconds", "value": total, "unit": "sec", "queries": timings, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
