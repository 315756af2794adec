"""Headline timings at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each entry is the full query, executed and counted through a no-op sink. One short query
runs first so that start-up of the JVM and of the Python workers is not billed to any.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F

from tidegauge.functions import month_start
from tidegauge.operators import grid
from tidegauge.plans import outlook, shapes
from tidegauge.plans.queries import QUERIES, flagship
from tidegauge.session import build_session, settle

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))

HEADLINE = [
    "panel_monthly",
    "tr_by_catalog",
    "exp_by_ref_h1",
    "exp_by_survey_month_raw",
    "ts_asfreq_month",
    "win_bfill_ffill",
    "jn_outer_nway",
    "agg_latest_complete",
    "scn_assemble",
    "mod_ridge",
    "mod_huber",
    "mod_yeo_johnson_lambda",
    "fc_recursive",
    "fc_bootstrap_interval",
    "serve_fanchart",
    "serve_yoy",
]

# targets of the interval forecast: how many series the same lines are cut into, and the
# model. Parts have months without lines, filled with the neighbour's value; more than half
# of their rows then fit exactly, which leaves the Huber scale undefined: they take Ridge.
TARGETS = {
    "forecast_targets_all": ("cast(0 as bigint)", "Huber"),
    "forecast_targets_supplier": ("l_suppkey", "Huber"),
    "forecast_targets_part": ("l_partkey", "Ridge"),
}


def target_frame(spark, key):
    """Monthly price, quantity and discount per target on the whole table's months."""
    cells = shapes.table(spark, SF_DIR, "lineitem").groupBy(
        F.expr(key).alias("target_id"), month_start(F.col("l_shipdate")).alias("data")
    ).agg(
        F.avg("l_extendedprice").alias("y"),
        F.avg("l_quantity").alias("quantity"),
        F.avg(F.col("l_discount") * 100).alias("discount"),
    )
    columns = ["y", "quantity", "discount"]
    dense = grid.asfreq_month(settle(cells, "cells"), ["target_id"], columns)
    return settle(grid.fill_both(dense, ["target_id"], columns), "frame")


def interval_forecast(spark, key, kind):
    """5000 paths of 12 steps per target, from the raw lines to the interval."""
    frame = target_frame(spark, key)
    exog = ["quantity", "discount"]
    scenario = outlook.seasonal_scenario(frame, ["target_id"], exog)
    return outlook.fit_and_forecast(frame, scenario, ["target_id"], exog, kinds=(kind,))


def timed(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = build_session(
        "bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
            "spark.log.level": "ERROR",
        },
    )
    timed(lambda: QUERIES["mod_ridge"](spark, SF_DIR))
    timings = {"flagship": timed(lambda: flagship(spark, SF_DIR))}
    for name in HEADLINE:
        timings[name] = timed(lambda: QUERIES[name](spark, SF_DIR))
    for name, (key, kind) in TARGETS.items():
        timings[name] = timed(lambda: interval_forecast(spark, key, kind))
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
