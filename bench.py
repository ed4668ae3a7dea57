"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from newswake.session import get_session

HEADLINE = [
    "gap_scan_simple", "gap_scan_history", "gap_scan_fallback", "gap_backfill", "gap_scan_pooled",
    "expectation_stats", "empirical_percentile", "forward_returns_135", "news_returns_build",
    "event_history_build", "upsert_partial", "gap_stats_grouping", "bm25_search", "phrase_search",
    "company_event_search", "knn_cosine", "label_rules", "keyphrases", "document_build",
    "company_extract", "rumor_verdicts", "similar_cases", "disclosure_verify",
    "disclosure_relevance", "stream_tumbling_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", {
        "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from newswake.plans.registry import QUERIES

    spark.read.parquet(f"{sf_dir}/region.parquet").count()
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3),
                      "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
