"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (comma-separated names) set what runs.  Every query is counted in
full, each result row passing through the whole plan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "risk_report", "dq_profile", "clean_data", "record_validation", "stratified_split",
    "scaler_stats", "scale_features", "logistic_score", "risk_band", "batch_summary",
    "classification_metrics", "roc_auc", "pr_auc", "threshold_sweep", "evaluate_all",
    "chart_curves", "knn_minority", "smote", "adasyn", "iforest_labels",
    "candidates", "text_similarity", "interaction_boost", "product_factor_scores", "recommend",
    "recommendation_log", "trending", "popular", "ndcg_at_k", "latency_percentiles",
    "rate_limit_offenders", "stream_trending", "stream_quarantine",
]


def main() -> None:
    from tallyrank.registry import QUERIES
    from tallyrank.session import build_session

    cpus = os.environ.get("BENCH_CPUS", "8")
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="12g", spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(os.path.join(root, "region.parquet")).count()
    took = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {took[name]:8.2f}s", file=sys.stderr, flush=True)
    lines = spark.read.parquet(os.path.join(root, "lineitem.parquet")).count()
    print(json.dumps({
        "metric": "headline queries, total wall time",
        "value": round(sum(took.values()), 3),
        "unit": "sec",
        "queries": took,
        "sf": os.path.basename(root.rstrip("/")).removeprefix("sf"),
        "rows_scored_per_sec": round(lines / took["logistic_score"]) if "logistic_score" in took else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
