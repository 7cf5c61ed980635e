"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_RUNS (default 3): each
query runs once to warm the JVM, then BENCH_RUNS times; the median counts. Rows go to the noop
sink, so every column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "raw_readiness", "placeholder_days", "tx_scan_limited", "btc_features", "btc_min_features", "eth_features",
    "features_all_chains", "norm_params", "zscore", "clean_training_rows", "drawdown_label", "netflow_7d", "auc",
    "evaluation_report", "sharpe_improvement", "signal_step", "signals_backfill", "alerts", "violations_daily",
    "upsert_signals", "signals_with_alerts", "recent_alerts", "chain_status", "train_score",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from checks.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(statistics.median(times[1:]), 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, sum of median seconds", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(os.path.normpath(sf_dir)),
    }))


if __name__ == "__main__":
    main()
