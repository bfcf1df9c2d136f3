"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "explore_lineitem", "profile_lineitem", "numeric_histogram", "distribution_stats", "top_values", "duplicate_rows",
    "calculated_columns", "association_matrix", "build_feature_spec", "random_split_stratified", "kfold_column", "time_split",
    "walk_forward_folds", "lag_features", "prepare_time_frame", "classification_metrics", "threshold_curve", "calibration",
    "regression_metrics", "group_check_number", "train_number", "score_number", "shap_additive_number", "surrogate_tree",
    "train_class", "train_bands", "train_over_time", "forecast", "score_targets", "rank_runs", "best_run",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tabscout.plans.catalog import QUERIES
    from tabscout.session import local_session

    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
