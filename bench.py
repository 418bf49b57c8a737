"""Time the headline queries on the driver's tables and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from aerocal import catalog  # noqa: E402
from aerocal.session import build_session  # noqa: E402

HEADLINE = (
    "hourly_resample",
    "resample_gapfill",
    "interpolate_forward",
    "outlier_mask_interpolate",
    "interpolate_long_series",
    "rolling_mean3",
    "dedupe_first_row",
    "station_pivot",
    "outer_join_variables_chain",
    "left_fuse",
    "coverage_by_day",
    "clean_sentinels",
    "impute_median",
    "median_by_rank",
    "compensate",
    "two_point_by_sensor",
    "baseline_affine",
    "metrics_by_split",
    "polyfit2_error",
    "trend_grid",
    "time_series_folds",
    "station_csv_ingest",
    "sensor_report_fused",
    "ols_baseline",
    "ridge_residual",
    "rf_residual",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    all_queries = catalog.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        all_queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("hourly_resample")  # starts the JVM's compiler and the file listing
    times = {name: round(run(name), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline query time",
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
