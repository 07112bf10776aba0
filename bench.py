"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

os.chdir(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, os.getcwd())

from pyspark.sql import SparkSession  # noqa: E402

from hinflow.plans import catalog  # noqa: E402
from hinflow.plans.scratch import cleared  # noqa: E402

QUERIES = (
    "exact_materialize_4hop", "relational_degree", "hindex_exact", "hub_degree_inclusive", "hub_f1", "kmv_propagate_2hop", "kmv_degree_estimate", "kmv_sparsified_edges",
    "mprw_edges", "kgrw_edges", "jaccard_fidelity", "matching_graph_edges", "linear_cka", "roc_auc", "edge_fraction_subgraph", "snapshot_degree_growth", "giant_component",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(4 * int(cpus))).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in QUERIES:
        start = time.time()
        with cleared(spark):
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
