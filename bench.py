"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then up to three times (median), its whole result consumed; when
four minutes are over, the remaining queries run once, warm-up included."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from shipcheck.plans import catalogue

QUERIES = ["h1_fold", "h3_hits", "h31_weight", "h32_containers", "d3_id_differences", "i1_classify", "i3_assess", "i5_extract", "d10_compare", "i7_decide"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took, deadline = catalogue.queries(), {}, time.time() + 240
    for name in QUERIES:
        runs = []
        for turn in range(4):
            if turn and time.time() > deadline:
                break
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            spark.catalog.clearCache()
            runs.append(time.time() - start)
        took[name] = round(statistics.median(runs[1:] or runs), 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
