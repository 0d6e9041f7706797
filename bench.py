"""Wall-clock bench of headline queries; prints one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]. Every query runs once
to warm up and then BENCH_RUNS times; the median is reported. All result rows are consumed by
the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from millrace.queries import QUERIES  # noqa: E402
from millrace.session import local_session  # noqa: E402

HEADLINE = (
    "b1_run_sql", "b7_inner_join", "b11_lateral_join", "b15_cube", "b19_frames", "b21_percentiles", "b23_set_operations",
    "c2_model_view", "c6_metrics_by_dimensions", "c9_sales_by_location",
    "d2_column_profile", "d2_profile_approx", "d6_top_values", "d17_functional_deps", "d18_inclusion_deps",
    "e2_histogram", "e3_describe_lineitem", "e7_correlation", "e12_moving_anomalies", "e16_smoothed_history", "e23_overview",
    "f1_infer_schema", "f11_impute_regression", "f12_fill_ordered", "f12_fill_ordered_whole", "e16_smoothed_gaps", "f15_outlier_report", "f18_winsorize", "f23_encode_target",
    "f30_mutual_information", "f31_validate", "f34_anova", "f35_chi2", "f36_drift_ks", "f37_drift_chi2", "f43_clean_values",
    "g9_knn_classify", "g18_classification_report", "g19_auc", "g21_regression_metrics",
    "h6_davies_bouldin", "h11_dbscan", "h12_isolation_forest", "h13_lof", "h16_cluster_profiles",
    "i2_keep_latest", "i5_lineage_downstream", "s1_tumbling_counts", "f44_replay",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    wanted = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session(cpus, "millrace-bench")
    seconds, errors = {}, {}
    for name in wanted:
        def once(fn=QUERIES[name]):
            start = time.perf_counter()
            fn(spark, folder).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start

        try:
            once()
            seconds[name] = round(statistics.median(once() for _ in range(runs)), 3)
        except Exception as error:  # noqa: BLE001 - report the query and go on
            errors[name] = f"{type(error).__name__}: {str(error)[:200]}"
    line = {
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }
    if errors:
        line["errors"] = errors
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
