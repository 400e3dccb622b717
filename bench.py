"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query is written to Spark's no-op sink: once to warm up, then the median of BENCH_RUNS runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakepipe.plans import QUERIES  # noqa: E402
from lakepipe.session import build_session  # noqa: E402

HEADLINE = [
    "churn_features",
    "silver_users",
    "order_stats",
    "event_stats",
    "loans_clean",
    "total_balances_all",
    "dq_metrics",
    "dq_results",
    "scd1",
    "scd2",
    "scd2_track_cols",
    "snapshot_diff",
    "sensor_stats",
    "sensor_hourly",
    "turbine_training",
    "turbine_training_binned",
    "latest_per_key",
    "score_latest",
    "package_trace",
    "flatten_struct",
    "json_autoparse",
    "json_two_level",
    "score_features",
    "churn_onehot_features",
    "impute_standardize",
    "timestamp_features",
    "slice_accuracy",
    "roc_points",
    "zip_join",
    "layout_clustered_write",
    "stream_silver",
    "stream_scd1",
    "stream_hourly",
    "rescued_data",
    "src_csv_by_header",
    "stream_expect",
    "stream_scd1_restart",
    "stream_scd2_stored",
    "cdc_factory_folders",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        started = time.perf_counter()
        QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in names:
        timed(name)
        seconds[name] = round(statistics.median(timed(name) for _ in range(runs)), 3)
        print(f"{name:28s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
