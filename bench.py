"""Wall time of the headline queries. Prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_ONLY (names).
Each query is planned and run to a sink that keeps every column; the best of two runs counts, after a
warm-up that is not timed.
"""

from __future__ import annotations

import json
import os
import time

from hydrolake.catalog import load
from hydrolake.session import local_session

HEADLINE = [
    "hourly_risk_status",
    "hourly_feature_store",
    "rolling_rain",
    "rain_streaks",
    "api_recursive",
    "calendar_lags",
    "forecast_7day",
    "daily_v6_features",
    "dataset_v4",
    "dataset_v6",
    "what_if_grid",
    "feedback_agreement",
    "buildings_at_risk",
    "zonal_percentiles",
    "tide_describe",
    "d8_direction",
    "flow_accumulation",
    "stratified_split",
    "upsample_classes",
    "knn_minority",
    "roc_auc_log",
    "pr_curve",
    "stream_hourly",
    "flood_probabilities",
    "hourly_model_status",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_ONLY", "").split() or HEADLINE
    spark = local_session(cpus, "bench")
    registry = load()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("sum(l_quantity)").collect()
    times = {}
    for name in names:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    print(
        json.dumps(
            {
                "metric": "wall time of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
