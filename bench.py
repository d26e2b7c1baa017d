"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default
all) the local cores. A query's result is written to the no-op sink, so every row
and column is computed and none reaches the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from readsift.checks import registry  # noqa: E402
from readsift.session import RECOMMENDED_CONF, released  # noqa: E402

HEADLINE = (
    "accepted_reads", "failed_reads", "deleted_reads", "labelled_reads", "neighbour_reads",
    "location_in_force", "days_to_billing", "features_by_date", "profile_categoricals",
    "profile_histograms", "category_vocabulary", "row_positions", "holdout_stratified",
    "folds_sliding", "folds_expanding", "folds_stratified", "permuted_labels",
    "confusion_matrix", "calibration_curve", "model_comparison", "encoded_vectors",
    "neighbour_predictions", "near_duplicates", "bayes_predictions", "tree_predictions",
    "perceptron_predictions", "cross_validation_of_rule",
    "exact_tree_predictions", "learning_curve_expanding_of_rule",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    wanted = sys.argv[1:] or HEADLINE
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("readsift-bench")
    for key, value in {
        **RECOMMENDED_CONF,
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        "spark.sql.shuffle.partitions": cpus if cpus != "*" else str(os.cpu_count()),
    }.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")

    queries, times = registry.queries(), {}
    queries["stacked_exceptions"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM
    for name in wanted:
        began = time.perf_counter()
        with released(spark):
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
