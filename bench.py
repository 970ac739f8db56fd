"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the
data and the local cores. Queries given as arguments replace the default list.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from registry.queries import QUERIES

HEADLINE = [
    "iqr_bounds", "outlier_to_null", "rare_to_null", "relative_frequency", "distinct_counts", "quantiles",
    "inject_missing", "inject_outliers_a", "inject_noise_a", "dirty_variant", "variant_grid",
    "impute_median", "standardise", "one_hot", "minmax", "clean_raw", "clean_fill", "clean_remove_fill", "clean_all",
    "repair_by_variant", "stratified_folds", "fold_stats", "clean_by_fold", "nb_scores", "auc", "auc_of_discounts",
    "roc_points", "threshold_search", "threshold_report", "nb_cv_auc", "nb_study", "result_summary",
    "baseline_delta", "method_model_table", "delta_curve", "boxplot_stats", "top_orders", "resolve_variant",
    "holdout_score",
]


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").groupBy("o_orderstatus").count().collect()  # start-up
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
