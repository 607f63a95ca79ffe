"""Time the headline queries; prints one JSON line.

The landing tables are written first and reported as ``setup_sec``: they stand for data that a
crawl has already stored. Everything from bronze on is timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from chatterlake.catalog import QUERIES  # noqa: E402
from chatterlake.plans.lake import Lake  # noqa: E402
from chatterlake.session import local_session  # noqa: E402

LANDING = ["search_requests", "crawl_runs", "raw_posts", "annotations", "gold_build_tracking"]
BUILD = ["bronze_posts", "silver_posts", "silver_ai_enrichment", "ai_jobs", "gold_post_search",
         "gold_campaign_daily", "gold_campaign_summary"]
HEADLINE = [
    "dedup_bronze", "silver_extract", "merge_tags", "gold_post_search_py", "campaign_daily",
    "campaign_summary", "top_hashtags", "campaign_analytics", "posts_by_keyword",
    "sentiment_breakdown", "filter_posts", "search_posts", "incremental_gold", "check_unique",
    "running_tokens", "admit_sliding", "score_sentiment", "detect_language", "extract_topic",
    "stream_silver", "full_refresh",
]


def main() -> None:
    source = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", shuffle_partitions=4 * int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    lake = Lake(spark, source)
    started = time.time()
    for name in LANDING:
        lake.layer(name)
    setup = time.time() - started
    seconds: dict[str, float] = {}
    for name in BUILD:
        started = time.time()
        lake.layer(name)
        seconds[f"write_{name}"] = round(time.time() - started, 3)
    for name in HEADLINE:
        started = time.time()
        QUERIES[name](lake).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(source.rstrip("/")),
        "setup_sec": round(setup, 3), "posts": lake.bronze_posts.count(),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
