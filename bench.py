"""Benchmark the headline queries.

Runs each query to completion with the ``noop`` sink (every row is
computed, nothing is collected to the driver) and prints one JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_QUERIES (comma list, default HEADLINE).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "share_by_group", "pivot_group_bucket", "rating_histogram", "sentiment_counts_share",
    "bucket_user", "engagement_by_sentiment", "engagement_share", "group_count_three",
    "join_inner_prefixed", "duplicate_count", "distinct_by_key", "binary_label",
    "scrub_integer", "strip_punct", "tokenize", "stopwords", "trigram_counts",
    "vocabulary_top", "idf_terms", "tfidf_top_per_doc", "keyed_split", "row_slice",
    "confusion_matrix", "binary_metrics", "auc_rank", "csv_roundtrip",
    "lr_metrics", "lr_scored_slice", "svm_unigram", "svm_trigram", "term_weights_top",
    "kmeans_sizes", "cluster_profile", "recluster", "recluster_second", "refinement_tree",
    "csv_by_ranges", "cross_tab", "class_metrics", "review_feeds", "dashboard", "vocabulary_sketch",
    "exact_split", "duplicate_sketch", "join_bucketed", "hinge_steps", "hinge_terms_top",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE

    from starlens.plans import QUERIES
    from starlens.session import local_session

    spark = local_session(cpus, shuffle_partitions=int(cpus) * 2, app="starlens-bench")
    # Warm-up on the tiny sf0.001 tables (JIT, codegen caches); no data is cached.
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm_dir):
        for name in ("share_by_group", "rating_histogram", "tokenize", "vocabulary_top", "idf_terms",
                     "lr_metrics", "kmeans_sizes"):
            QUERIES[name](spark, warm_dir).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
