"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from tidemark.plans import engine_queries
from tidemark.session import build_session

HEADLINE = [
    "movements_h60", "movements_keyed", "movements_multi", "correlation_pearson", "correlation_spearman", "bucketize", "range_analysis",
    "overall_stats", "outliers_iqr", "outliers_zscore", "optimal_boundaries", "validate_boundaries", "kfold", "walk_forward", "backtest", "live_expectation",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("OFF")
    queries, took = engine_queries(), {}
    queries["statistics"](spark, sf_dir).collect()  # starts the session
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
