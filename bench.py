"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query is run
over its whole input; after one run to warm up, the better of two counts. Training
runs once.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame

from salescast.plans.panel import training_panel
from salescast.session import local_session
from salescast.sources.retail import FIRST_DAY, retail_sales
from salescast.verification.queries import queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))

HEADLINE = [
    "daily_sales",
    "dense_daily",
    "temporal_split",
    "target_describe",
    "null_counts",
    "config_selection",
    "model_comparison",
    "latest_features",
    "predict_baseline",
    "predict_requests",
]
# The whole panel over more and more series: its unit and item columns.
PANELS = {
    "training_panel": ("nation", "type"),
    "panel_nation_brand": ("nation", "brand"),
    "panel_supplier_type": ("supplier", "type"),
}
# The first of these trains all models (reported as ``training``), the others use them.
TREES = ["tuning_results", "gbt_test_forecast", "predict_batch"]


def seconds(build: Callable[[], DataFrame]) -> float:
    started = time.perf_counter()
    build().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - started, 3)


def main() -> None:
    spark = local_session(CPUS, shuffle_partitions=2 * CPUS, memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    registered = queries()

    def whole_panel(unit: str, item: str) -> Callable[[], DataFrame]:
        return lambda: training_panel(retail_sales(spark, SF_DIR, unit, item), start=FIRST_DAY)

    builds = {name: (lambda name=name: registered[name](spark, SF_DIR)) for name in HEADLINE}
    builds.update({name: whole_panel(*grain) for name, grain in PANELS.items()})
    times = {}
    for name, build in builds.items():
        seconds(build)
        times[name] = min(seconds(build), seconds(build))
    for name in TREES:
        times[name] = seconds(lambda name=name: registered[name](spark, SF_DIR))
    times["training"] = times.pop("tuning_results")
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(Path(SF_DIR).name.removeprefix("sf") or 0),
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
