"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = HERE + os.pathsep + os.environ.get("PYTHONPATH", "")
sys.path.insert(0, HERE)

HEADLINE = ["forward_spots", "coarse_match", "score_rank_topk", "merge_leaders", "unique_claims", "misorientation_pairs", "nearest_peak", "threshold_mad", "connected_components", "image_summary"]


def main() -> None:
    from pyspark.sql import SparkSession

    from braggflow.plans import derive
    from braggflow.plans.registry import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    rows = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet").count()
    per_second = {"forward_spots_projections": round(rows("orders") * derive.hkls(spark).count() / seconds["forward_spots"]), "coarse_match_frame_orientations": round(rows("supplier") * rows("customer") / seconds["coarse_match"])}
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "per_second": per_second, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
