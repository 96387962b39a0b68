"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from seclake.queries import QUERIES  # noqa: E402

HEADLINES = [
    "scan_documents_all_rules", "scan_code_all_rules", "scan_pages", "scan_conversations", "fam05_xss", "fam27_credentials",
    "flt21_history_findings", "tnt07_taint_findings", "src12_file_changes", "src14_added_lines", "jn01_without_ignored",
    "jn04_apply_baseline", "jn08_auto_verify", "jn11_vulnerable_packages", "agg01_summary", "agg05_security_score",
    "agg08_rule_stats", "agg17_safe_helpers", "agg23_posture", "win10_insights", "fn14_proposed_fixes", "snk04_text",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.TemporaryDirectory(prefix="bench-")  # local mode: driver and executors are one process
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", folder.name).config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINES
    # One untimed query starts the Python workers and warms the JVM.
    QUERIES["fam10_cors"](spark, sf).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()
    folder.cleanup()


if __name__ == "__main__":
    main()
