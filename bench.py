"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the folder of test tables, BENCH_CPUS the local threads. Every query
runs from the raw feeds to its last row, planning included, three times, and the median
counts; rows go to a sink that drops them, so large results are not slowed by fetching
them into Python.
"""

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from workloads import catalog  # noqa: E402

RUNS = 3
HEADLINE = (
    "ingest_generation",
    "ingest_weather",
    "stg_prices",
    "best_windows",
    "carbon_heatmap",
    "prices_carbon_recent",
    "fuel_mix_pivot",
    "renewable_weather",
    "grid_stress_recent",
    "demand_profile",
    "appliance_windows_by_zone",
    "renewable_mix_by_zone",
    "stream_upsert",
    "stream_ingest",
    "stream_fuel_mix",
    "now_summary_by_zone",
    "percent_rank_ranges_by_zone",
    "stg_generation",
    "price_carbon",
    "price_heatmap",
    "fuel_mix_hourly",
    "renewable_mix",
    "temp_vs_demand",
    "grid_stress",
    "regional_latest",
    "weather_indices",
    "now_summary",
    "appliance_windows",
    "windows_by_day",
    "best_windows_top5",
    "combined_heatmap",
    "kpi_summary",
    "temp_regression",
    "percent_rank_global",
    "dq_checks",
    "best_windows_by_zone",
    "incremental_upsert",
    "lake_build",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # Records the Python call site of every column; costs several calls per column.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.flagship(spark, sf_dir).collect()  # starts the JVM's classes, not timed
    seconds = {}
    for name in HEADLINE:
        took = []
        for _ in range(RUNS):
            started = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - started)
        seconds[name] = round(median(took), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    line = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
