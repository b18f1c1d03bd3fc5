"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (sum of query seconds), "unit",
"queries": {name: seconds}, "sf"}. Each query's result is fully computed
with the no-op sink (no collect to the driver). Timings are steady-state: an
untimed pass of the same queries over the smallest supplied scale factor
(``$BENCH_WARM_DIR``, default sf0.001) warms the JVM's JIT and Spark's
code-generation cache first; set BENCH_WARM_DIR="" to time cold runs.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "profile_lineitem", "describe_lineitem", "skew_lineitem", "correlation_matrix", "top_values_orders",
    "duplicate_rows", "missing_table", "clean_dedupe", "impute_median", "cap_iqr", "remove_outliers",
    "convert_types", "apply_plan", "histogram_price", "density_price", "box_by_flag", "bar_priority",
    "trendline", "heatmap_features", "top_correlations", "standard_scale", "one_hot", "hash_split",
    "classification_metrics", "roc_auc_binary", "roc_auc_ovr", "regression_metrics", "kmeans_search",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    from tablewise.session import get_spark
    from tablewise.queries import QUERIES
    spark = get_spark(f"local[{cpus}]", app="tablewise-bench", shuffle_partitions=int(cpus) * 2,
                      conf={"spark.driver.memory": "16g"})
    warm_dir = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    if warm_dir and os.path.isdir(warm_dir):
        for name in only:  # untimed warm-up at the smallest scale
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
