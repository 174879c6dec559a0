"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query is planned and run anew; after
four warm-up runs the median of ``BENCH_RUNS`` runs counts. Results go to a sink that reads every row.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import time

from pyspark.sql import SparkSession

from wardcast.plans.catalogue import QUERIES

HEADLINE = [
    "cohort_retention",
    "enriched_admissions",
    "grouped_admissions",
    "admissions_by_label",
    "yearly_history",
    "observed_rate",
    "projection_by_region",
    "scenario_costs_long",
    "secondary_profile",
    "either_diagnosis_uplift",
    "territory_score",
    "ageing_summary",
]


def session(cores: int) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def seconds(spark: SparkSession, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = session(cores)
    times: dict[str, float] = {}
    for name in HEADLINE * 2:
        seconds(spark, name, sf_dir)
    for name in HEADLINE:
        for _ in range(2):
            seconds(spark, name, sf_dir)
        times[name] = round(statistics.median(seconds(spark, name, sf_dir) for _ in range(runs)), 3)
    spark.stop()
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else sf_dir,
                "cores": cores,
            }
        )
    )


if __name__ == "__main__":
    main()
