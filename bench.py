"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tallyspark import queries as engine

HEADLINES = {
    "rank_unique_views": "rank_unique_lines",
    "rank_unique_views_top_20": "top_k_unique_lines",
    "unique_views_of_type": "count_unique_lines",
    "count_in_period": "count_between",
    "per_entity_counts": "with_multi_counts",
    "summary_counts": "summary_counts",
    "view_owner": "view_owner",
    "cooldown_per_item": "gate_cooldown",
    "cooldown_namespace": "gate_cooldown_namespace_flush",
    "ingest": "record_rows",
}
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = {}
    for name, query in HEADLINES.items():
        times = []
        for _ in range(RUNS + 1):  # the first warms up
            began = time.perf_counter()
            engine.queries()[query](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        found[name] = round(statistics.median(times[1:]), 3)
    print(json.dumps({"metric": "total_time", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
