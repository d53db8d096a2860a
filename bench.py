"""Runs headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tickwell.plans import market

HEADLINES = ["w6_bollinger_pct_b", "w2_rsi", "x3_edge_scores", "b1_rebalance", "b3_signal_trades", "r10_summary", "r12_correlation", "m3_fan_bands", "v5_attribute_events", "o2_shrunk_covariance"]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    market.QUERIES["w1_ema"](spark, sf).count()
    took = {}
    for name in HEADLINES:
        began = time.time()
        market.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
