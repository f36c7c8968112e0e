"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from roadlens.plans.queries import QUERIES

HEADLINE = [
    "segment_summary",
    "road_penalties",
    "segment_tokens",
    "congestion_hotspots",
    "ubcf_topn",
    "ibcf_topn",
    "popular_fallback",
    "user_similarity",
    "via_safety_rating",
    "graph_stats",
    "edge_costs",
    "nearest_node",
    "route_variants",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "8g"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["via_top30"](spark, sf_dir).collect()  # starts the engine
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_wall_clock", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))[2:], "cpus": cpus, "spark": spark.version}))


if __name__ == "__main__":
    main()
