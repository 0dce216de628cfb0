"""Benchmark: run the headline queries at $BENCH_SF_DIR (default
/root/testdata/sf0.1) on local[$BENCH_CPUS] and print one JSON line.

Each query is executed to completion with the no-op sink (the whole plan
runs, nothing is collected to the driver); fit steps inside a query run
their own (small) jobs as part of the timing.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewise.plans.catalog import QUERIES  # noqa: E402
from tidewise.session import get_spark  # noqa: E402

HEADLINE = [
    "clean", "feature_table", "prior_transactions_24h", "describe_all", "quality_issues",
    "correlation_matrix", "histograms", "boxplot_by_target", "category_cardinality",
    "duplicate_rows", "cleaning_report", "validate_recommendations", "diagnose",
    "stratified_split", "standard_scale", "train_logistic", "train_random_forest",
    "train_gbt", "train_svc_linear", "train_svc_rbf", "improve_loop", "column_summary", "data_summary",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_spark(master=f"local[{cpus}]", partitions=cpus)
    keys = sys.argv[1:] or HEADLINE
    QUERIES["shape"](spark, sf_dir).collect()  # JVM warm-up, not timed
    times = {}
    for k in keys:
        t0 = time.perf_counter()
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir, "cpus": cpus}))


if __name__ == "__main__":
    main()
