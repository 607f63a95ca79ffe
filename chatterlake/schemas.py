"""Table schemas, enumerations and schema evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Enumerations of the data model.
PLATFORMS = ["twitter", "facebook", "instagram", "youtube", "reddit"]
SENTIMENTS = ["positive", "negative", "neutral"]
RUN_STATES = ["pending", "running", "completed", "failed"]
JOB_TYPES = ["sentiment", "topic", "language", "full_enrichment"]

_S, _L, _I, _D = "string", "bigint", "int", "double"
_TS, _DAY, _B, _A = "timestamp_ntz", "date", "boolean", "array<string>"


def _struct(**columns: str) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in columns.items()))


SEARCH_REQUESTS = dict(
    id=_S, keyword=_S, start_date=_DAY, end_date=_DAY, platform=_S, status=_S,
    posts_found=_L, created_at=_TS, updated_at=_TS,
)
CRAWL_RUNS = dict(
    id=_S, search_request_id=_S, platform=_S, status=_S, posts_fetched=_L,
    error_message=_S, started_at=_TS, completed_at=_TS,
)
BRONZE_POSTS = dict(
    id=_L, search_request_id=_S, crawl_run_id=_S, platform=_S, platform_id=_S,
    author_handle=_S, raw_payload=_S, fetched_at=_TS,
)
SILVER_POSTS = dict(
    id=_L, bronze_post_id=_L, search_request_id=_S, platform=_S, platform_id=_S,
    author_handle=_S, author_name=_S, post_text=_S, posted_at=_TS, like_count=_L,
    share_count=_L, reply_count=_L, view_count=_L, post_url=_S, is_retweet=_B, created_at=_TS,
)
ENRICHMENT = dict(
    id=_S, silver_post_id=_L, ai_version=_I, hashtags=_A, mentions=_A, language=_S,
    topic_label=_S, topic_confidence=_D, reach_estimate=_L, sentiment=_S,
    sentiment_confidence=_D, metadata_model_name=_S, metadata_model_version=_S,
    sentiment_model_name=_S, sentiment_model_version=_S, created_at=_TS,
)
AI_JOBS = dict(
    id=_S, silver_post_id=_L, job_type=_S, status=_S, ai_version=_I, attempts=_I,
    max_attempts=_I, error_message=_S, started_at=_TS, completed_at=_TS, created_at=_TS,
)
LINEAGE = dict(source_crawl_run_id=_S, enrichment_job_id=_S, lineage_updated_at=_TS)
GOLD_POSTS = dict(
    id=_L, search_request_id=_S, keyword=_S, platform=_S, author_handle=_S, author_name=_S,
    post_text=_S, posted_at=_TS, post_url=_S, sentiment=_S, sentiment_confidence=_D,
    topic_label=_S, topic_confidence=_D, language=_S, hashtags=_A, mentions=_A, like_count=_L,
    share_count=_L, reply_count=_L, view_count=_L, ai_version=_I, created_at=_TS,
)
CAMPAIGN_DAILY = dict(
    search_request_id=_S, keyword=_S, platform=_S, date=_DAY, total_posts=_L,
    positive_count=_L, negative_count=_L, neutral_count=_L, avg_confidence=_D,
    top_hashtags=_A, top_topics=_A, total_likes=_L, total_shares=_L, total_replies=_L,
    total_views=_L, ai_version=_I, created_at=_TS,
)
CAMPAIGN_SUMMARY = dict(
    search_request_id=_S, keyword=_S, start_date=_DAY, end_date=_DAY, total_posts=_L,
    positive_pct=_D, negative_pct=_D, neutral_pct=_D, avg_confidence=_D, total_engagement=_L,
    total_likes=_L, total_shares=_L, total_replies=_L, total_views=_L, top_hashtags=_A,
    top_topics=_A, platforms=_A, ai_version=_I, created_at=_TS,
)
BUILD_TRACKING = dict(search_request_id=_S, last_built_at=_TS, posts_processed=_L)

TABLES = {
    "search_requests": SEARCH_REQUESTS,
    "crawl_runs": CRAWL_RUNS,
    "bronze_posts": BRONZE_POSTS,
    "silver_posts": SILVER_POSTS,
    "silver_ai_enrichment": ENRICHMENT,
    "ai_jobs": AI_JOBS,
    "gold_post_search": GOLD_POSTS,
    "gold_campaign_daily": CAMPAIGN_DAILY,
    "gold_campaign_summary": CAMPAIGN_SUMMARY,
    "gold_build_tracking": BUILD_TRACKING,
}

# Schema history. Version 1 is the base schema without these columns.
SCHEMA_CHANGES = {
    2: {"silver_ai_enrichment": ["topic_confidence"], "gold_post_search": ["topic_confidence"]},
    3: {"gold_build_tracking": list(BUILD_TRACKING)},
    5: {t: list(LINEAGE) for t in
        ("gold_post_search", "gold_campaign_daily", "gold_campaign_summary")},
}
SCHEMA_VERSION = max(SCHEMA_CHANGES)


def struct_of(table: str) -> T.StructType:
    return _struct(**TABLES[table])


def columns_at(table: str, version: int = SCHEMA_VERSION) -> dict[str, str]:
    """Columns of a table as of a schema version; empty before the table existed."""
    if version < 1:
        raise ValueError(f"schema version must be at least 1, got {version}")
    columns = dict(TABLES[table])
    for introduced, change in sorted(SCHEMA_CHANGES.items()):
        for name in change.get(table, []):
            if introduced <= version:
                columns[name] = columns.get(name) or LINEAGE[name]
            else:
                columns.pop(name, None)
    return columns


def evolve_schema(df: DataFrame, table: str, version: int = SCHEMA_VERSION) -> DataFrame:
    """Bring a table to a schema version: add missing columns as NULL, drop later ones.

    A pure projection, so it is idempotent and costs no shuffle in either direction.
    """
    have = set(df.columns)
    return df.select(
        *[
            (F.col(n) if n in have else F.lit(None)).cast(t).alias(n)
            for n, t in columns_at(table, version).items()
        ]
    )
