"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from tidemark.plans.queries import QUERIES

HEADLINE = (
    "points_in_zones", "buildings_outside_zones", "zone_of_building", "zone_prevalence", "zone_cells_sampled",
    "zone_cell_centres", "nearest_bfe", "nearest_bfe_three", "clean_buildings", "panel_as_of_each",
    "buildings_wide", "layer_violations", "zone_geojson", "published_layer", "points_in_zones_shuffled",
    "nearest_bfe_shuffled", "panel_as_of_each_shuffled", "nearest_bfe_same_datum", "points_in_geojson_zones",
)


def run(spark: SparkSession, name: str, sf_dir: str) -> tuple[float, float]:
    """Seconds to build the plan, with the size checks it runs, and in all."""
    start = time.perf_counter()
    df = QUERIES[name](spark, sf_dir)
    built = time.perf_counter() - start
    df.write.format("noop").mode("overwrite").save()
    return built, time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, building = {}, {}
    run(spark, "zone_prevalence", sf_dir)  # warms the session up
    for name in HEADLINE:
        run(spark, name, sf_dir)
        built, total = run(spark, name, sf_dir)
        seconds[name], building[name] = round(total, 3), round(built, 3)
    print(json.dumps({
        "metric": "headline queries, second of two runs, total wall time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "of_which_building": building,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
