"""Time the headline queries; prints one JSON line.

Each query runs once to warm up and then three times; the median counts. Results are consumed
in full by a sink that keeps nothing, so no query is cut short by column pruning of a count.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from driver_queries import QUERIES

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
HEADLINE = (
    "join_chain3", "join_full", "date_window", "user_rules_flag_reasons", "feature_all",
    "busday_gap", "rules_combined", "exclude_rule_rows", "rule_duplicate_invoice",
    "drop_void_duplicates", "cleaning_summary", "numeric_profile", "training_sample",
    "forest_scores", "explain", "dataset_summary", "table_options", "latest_per_group",
    "anomaly_list", "report_rows", "reason_stats", "trend",
)


def consume(name: str, spark: SparkSession) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        consume(name, spark)
        seconds[name] = round(statistics.median(consume(name, spark) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(FOLDER.rstrip("/")),
        "cpus": int(CPUS), "runs": RUNS,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
