"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from metergrid.queries import queries
from metergrid.workload import usage_store

HEADLINE = ("totals_30d", "by_model", "marginals", "daily_by_model", "hourly_today_kathmandu", "sessions", "project_insights", "facets", "reprice", "unresolved_pricing", "merge_preserve_metadata", "owner_dedup", "counter_delta_reset")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    found = queries()
    found["owner_dedup"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm-up
    start = time.perf_counter()
    usage_store(spark, sf_dir)  # the stored table that the dashboard queries read
    seconds = {"store_create": round(time.perf_counter() - start, 3)}
    for name in HEADLINE:
        start = time.perf_counter()
        found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
