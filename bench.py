"""Times the headline queries on one session and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["describe", "profile", "duplicated", "histogram", "label_encode", "standardize", "regression_metrics", "linear_2", "knn_predict",
            "knn_cv", "predict_scan", "greedy_2", "distance_correlation", "covariance", "knockoffs", "shapley_linear", "coranking",
            "embedding_quality", "pca_k", "robust_pca"]


def main() -> None:
    from colscope.session import build_session, clear_scratch
    from colscope.suite import load

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries = load()[0]
    names = [n for n in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if n in queries]
    # starts the Python workers, so that no query pays for it
    spark.range(1000).repartition(int(cpus) if cpus.isdigit() else 8).mapInPandas(lambda it: it, "id bigint").count()
    took = {}
    for n in names:
        t = time.perf_counter()
        queries[n](spark, sf).write.format("noop").mode("overwrite").save()
        took[n] = round(time.perf_counter() - t, 3)
        print(n, took[n], file=sys.stderr, flush=True)
    clear_scratch(spark)
    spark.stop()
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
