"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsgauge.plans.registry import QUERIES  # noqa: E402
from newsgauge.session import local_session  # noqa: E402

HEADLINES = [
    "scan_csv", "scan_labelled_files", "null_profile", "full_text", "sample_n", "prompt_fanout",
    "score_batch", "affect_profile", "parse_verdict", "attach_profile", "resume_todo",
    "mean_affect_by_source_label", "ttest_by_label", "paper_table", "high_emotion_counts",
    "dominant_pct", "bucket_pct", "affect_histogram", "cosine_similarity", "mean_pool",
    "retrieve_top4", "evidence_top_k", "evidence_text", "verified_article", "standardize",
    "affective_distance", "stratified_folds_shuffled", "nearest_centroid_cv",
    "classification_report", "kmeans_labels", "gmm_labels", "logreg_cv", "logreg_weights",
    "classify_affect",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="bench-")  # one machine
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8, folder)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        # A line per query, so that a run that is stopped shows how far it came.
        print(f"{name} {seconds[name]} s", file=sys.stderr, flush=True)
    spark.stop()
    shutil.rmtree(folder, ignore_errors=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
