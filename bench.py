"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is written to the noop sink in full. What one query shares with the next (the analysis
of the derived orders table, cached or checkpointed steps) is forgotten before each run, so a time
is the time of the whole job. A small warm-up pays for JVM and Python worker start.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.compare import session  # noqa: E402
from checks.queries import QUERIES, fresh  # noqa: E402

HEADLINE = (
    "pr1_column_counts_lineitem", "pr4_duplicate_rows_lineitem", "pr6_numeric_profile_lineitem", "pr9_nearest_quantile_lineitem",
    "pr12_top_values_documents", "pr14_text_profile_conversations", "in7_formula_injection_scan", "qi4_numeric_sentinels",
    "qi11_quality_issues", "st4_pearson_matrix_lineitem", "st10_residual_spread", "st14_reversal_stats", "st19_standardize",
    "st20_pca_summary", "st21_kmeans_elbow", "fn15_executive_summary", "hx1_latest_per_session", "rl1_requests_in_window",
    "tx3_numbered_list",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    for key in ("pr1_column_counts_lineitem", "st4_pearson_matrix_lineitem"):
        QUERIES[key](spark, folder.replace("sf0.1", "sf0.001")).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        fresh()
        spark.catalog.clearCache()
        start = time.time()
        QUERIES[key](spark, folder).write.format("noop").mode("overwrite").save()
        times[key] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
