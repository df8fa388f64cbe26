"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the cores.  Each query is written to Spark's no-op sink, so all of its
rows are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from gridevents import catalog
from gridevents.session import RECOMMENDED

HEADLINE = [
    "x01_landfall_events", "x03_composite_raw", "x04_composite_anomaly", "x05_composite_native",
    "x06_composite_lagged", "x07_composite_lagged_points", "x08_lagged_region", "x11_cluster_averages",
    "x12_discrepancy_timeline", "x13_moist_energies", "x14_wave_mask", "x15_eof_standardise",
    "x16_consensus_filter", "x17_monthly_anomaly", "x18_mask_frequency",
    "j01_asof_nearest", "j02_asof_lagged", "j03_box_join", "j05_climatology_anomaly", "j07_three_way",
    "w03_event_ordinals", "w06_batched_zscore", "w08_gradient_lat", "r01_feature_vectors", "r04_timeline",
    "m03_squared_silhouette", "m04_k_sweep", "x09_cluster_events", "x10_cluster_pooled",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder.master(f"local[{cpus}]").appName("bench")
               .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
             .config("spark.checkpoint.dir", os.environ.get("SHARED_DIR") or tempfile.mkdtemp(prefix="shared-"))
               .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC"))
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    # one untimed query starts the executors and the JIT
    queries["x18_mask_frequency"](spark, folder).write.format("noop").mode("overwrite").save()
    chosen = os.environ.get("BENCH_QUERIES")
    seconds = {}
    for name in chosen.split(",") if chosen else HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
