"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the local cores. Every query runs twice, from
building the plan to the last row; the second run counts, so JVM warm-up does not.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from workload.queries import QUERIES  # noqa: E402

HEADLINES = [
    "score",
    "all_findings",
    "score_from_findings",
    "summary",
    "repair_steps",
    "repair_plan",
    "top_steps",
    "decision",
    "fleet_cube",
    "by_file",
    "position_lookup",
    "selected_files",
    "gitignore_filter",
    "capped_files",
    "file_classes",
    "project_context",
    "d_console_log",
    "d_localhost",
    "d_secrets",
    "d_missing_auth",
    "d_excess_any",
    "inline_ignores",
    "fix_console_log",
    "apply_fix",
    "fix_verify",
    "scan_diff",
    "merge_findings",
    "rescan_scores",
    "scan_configs",
    "span_lookup",
    "debounce_saves",
    "stream_debounce",
    "stream_scores",
    "redact",
    "trimmed_lines",
    "result_json",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="fleetscan-bench-")  # one process, removed at its end
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fleetscan-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", folder)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINES
    times = {}
    for name in names:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
