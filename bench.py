"""Time the headline queries and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

HEADLINE = [
    "score_table_heuristic", "priority_queue", "rank_leads_expected_value", "lead_stats", "lift_by_decile",
    "exact_auc", "classification_metrics", "calibration_report", "segment_thresholds", "detect_leakage",
    "psi", "clean_frame", "upsert_leads", "record_outcomes", "column_profile", "explain_ablation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("leadlake-bench")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from leadlake.plans import fixtures
    from leadlake.plans.catalog import QUERIES

    n_leads = fixtures.leads(spark, sf_dir).count()  # also warms the JVM
    times = {}
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
    total = round(sum(times.values()), 3)
    scored = times["score_table_heuristic"]
    print(json.dumps({
        "metric": "headline queries, total", "value": total, "unit": "sec", "queries": times,
        "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": cpus, "leads": n_leads,
        "leads_scored_per_sec": round(n_leads / scored, 1),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
