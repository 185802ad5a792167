"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and once to be timed (BENCH_RUNS times); results are written to Spark's
``noop`` sink, so that every row is made.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (HERE, os.environ.get("PYTHONPATH")) if x)

HEADLINE = [
    "metapath_customer_supplier",
    "epsilon_pairs",
    "exact_unweighted_matrix",
    "exact_unweighted_topk",
    "exact_unweighted_topk_batch",
    "exact_kernel_topk",
    "exact_weighted_topk",
    "grid_unweighted_topk",
    "quality_precision_recall",
    "neighbor_counts",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from waymesh.plans import queries as graph

    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus, runs = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    known, took = graph.queries(), {}
    for name in HEADLINE:
        each = []
        for n in range(runs + 1):
            began = time.perf_counter()
            known[name](spark, d).write.format("noop").mode("overwrite").save()
            if n:
                each.append(time.perf_counter() - began)
        took[name] = round(statistics.mean(each), 3)
    print(json.dumps({"metric": "seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(d.rstrip("/")), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
