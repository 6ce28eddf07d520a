"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Prints one JSON line: {"metric": "total_sec", "value": N, "unit": "sec",
"queries": {name: sec}, "sf": ...}.  Each query is fully materialised with
the ``noop`` sink (no collect to the driver); the session is warmed once
before timing.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "l12_label_skew", "f0_sql_features", "l2_label_quantile", "l11_tier_label", "q4_median_runtime",
    "q6_failure_breakdown", "e5_classification_report", "e6_roc_auc_by_db", "e7_roc_curve", "e14_rolling_r2",
    "e16_model_comparison", "t2_split_random_stratified", "t4_split_within_group_stratified", "t6_stratified_folds",
    "c1_schema_stats", "c6_five_point", "h7_merge_history_into_training", "r2_runtime_histogram_30",
    "w3_join_group_top", "w5_three_way_avg_top", "w12_exists", "w13_nested_scalar",
    "p11_tree_mean", "p12_global_vector", "m3_ridge_one_feature", "m15_regress_holdout",
    "m17_logistic_per_db", "m23_two_geometries_fixed_model", "m9_cross_validate", "m28_learning_curve",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from querylens import registry
    from querylens.checks.common import clear_shared
    from querylens.session import get_spark

    scratch = tempfile.mkdtemp(prefix="querylens-bench-")
    spark = get_spark(f"local[{cpus}]", int(cpus), extra={
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
        "spark.local.dir": scratch})
    registry.load_all()
    # warm-up on the smallest tables (JVM code paths, checkpoint folder, Python workers)
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for w in ("l12_label_skew", "f0_sql_features", "m3_ridge_one_feature"):
        registry.QUERIES[w](spark, warm_dir).write.format("noop").mode("overwrite").save()
    clear_shared()
    times = {}
    for n in names:
        clear_shared()  # every query pays for its own intermediates
        t0 = time.perf_counter()
        registry.QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[n] = round(time.perf_counter() - t0, 3)
        # release the finished query's shuffles / broadcasts / checkpoints (outside the timing)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
           "sf": float(m.group(1)) if m else sf_dir}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
