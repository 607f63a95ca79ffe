"""Joins between the layers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlake.catalog.registry import query
from chatterlake.functions.times import ntz
from chatterlake.operators import gold as G
from chatterlake.operators import silver as S
from chatterlake.operators.serve import explode_hashtags, newest

CUT = "2024-01-20 00:00:00"


def _stored_silver(lake):
    """Silver as it was when posts after the cut had not been processed."""
    return lake.silver_posts.filter(F.col("created_at") < ntz(CUT))


@query("unenriched_posts", f"""
    SELECT b.id, md5(json_extract_string(raw_payload, '$.text')) AS text_md5, fetched_at
    FROM bronze_posts b
    WHERE NOT EXISTS (SELECT 1 FROM silver_posts s
        WHERE s.bronze_post_id = b.id AND s.created_at < TIMESTAMP '{CUT}')
    ORDER BY fetched_at, b.id LIMIT 100""")
def _(lake):
    return S.unenriched_posts(lake.bronze_posts, _stored_silver(lake), 100).select(
        "id", F.md5(F.get_json_object("raw_payload", "$.text")).alias("text_md5"), "fetched_at"
    )


@query("unenriched_posts_all", f"""
    SELECT id, search_request_id FROM bronze_posts b
    WHERE id NOT IN (SELECT bronze_post_id FROM silver_posts WHERE created_at < TIMESTAMP '{CUT}')
    """)
def _(lake):
    return S.unenriched_posts(lake.bronze_posts, _stored_silver(lake)).select(
        "id", "search_request_id"
    )


@query("posts_needing_enrichment", """
    SELECT id FROM silver_posts
    WHERE id NOT IN (SELECT silver_post_id FROM enrichment)
        AND id NOT IN (SELECT silver_post_id FROM ai_jobs
            WHERE status = 'failed' AND attempts >= max_attempts)""")
def _(lake):
    return S.posts_needing_enrichment(
        lake.silver_posts, lake.silver_ai_enrichment, lake.ai_jobs
    ).select("id")


@query("bronze_to_silver_new", f"""
    SELECT id, author_name, md5(post_text) AS text_md5, posted_at, like_count FROM silver_posts
    WHERE created_at >= TIMESTAMP '{CUT}'""")
def _(lake):
    return S.bronze_to_silver_new(lake.bronze_refs, _stored_silver(lake), lake.with_payloads).select(
        "id", "author_name", F.md5("post_text").alias("text_md5"), "posted_at", "like_count"
    )


_GOLD = """id, search_request_id, keyword, platform, author_handle, author_name,
    md5(post_text) AS text_md5, posted_at, post_url, sentiment, sentiment_confidence,
    topic_label, topic_confidence, language, array_to_string(hashtags, ',') AS hashtags,
    array_to_string(mentions, ',') AS mentions, like_count, share_count, reply_count, view_count,
    ai_version"""


def _gold(lake, posts):
    return lake.with_texts(posts).select(
        "id", "search_request_id", "keyword", "platform", "author_handle", "author_name",
        F.md5("post_text").alias("text_md5"), "posted_at", "post_url", "sentiment",
        "sentiment_confidence", "topic_label", "topic_confidence", "language",
        F.array_join("hashtags", ",").alias("hashtags"),
        F.array_join("mentions", ",").alias("mentions"),
        "like_count", "share_count", "reply_count", "view_count", "ai_version",
    )


def _layers(lake):
    return lake.silver_refs, lake.silver_ai_enrichment, lake.search_requests


@query("gold_post_search_py", f"SELECT {_GOLD} FROM gold")
def _(lake):
    return _gold(lake, G.gold_post_search(*_layers(lake)))


def _keyed_layers(lake):
    return lake.keyed("silver_refs", "id"), lake.keyed("silver_ai_enrichment", "silver_post_id"), lake.search_requests


@query("gold_post_search_keyed", f"SELECT {_GOLD} FROM gold")
def _(lake):
    """Layers with equal buckets by post id are joined where they lie."""
    return _gold(lake, G.gold_post_search(*_keyed_layers(lake)))


@query("gold_post_search_latest", f"""
    SELECT {_GOLD} FROM gold_all
    QUALIFY row_number() OVER (PARTITION BY id ORDER BY ai_version DESC) = 1""")
def _(lake):
    return _gold(lake, G.gold_post_search(*_layers(lake), ai_version="latest"))


@query("gold_post_search_sql", f"""
    SELECT {_GOLD} FROM gold_all n WHERE NOT EXISTS (
        SELECT 1 FROM gold g WHERE g.created_at < TIMESTAMP '{CUT}'
            AND g.search_request_id = n.search_request_id AND g.platform = n.platform
            AND g.posted_at = n.posted_at AND g.author_handle = n.author_handle
            AND g.post_text = n.post_text)""")
def _(lake):
    stored = lake.gold_refs.filter(F.col("created_at") < ntz(CUT))
    return _gold(lake, G.gold_post_search_all_versions(*_layers(lake), stored, read=lake.with_texts))


@query("gold_post_search_dbt", f"SELECT {_GOLD} FROM gold_all")
def _(lake):
    view = G.silver_with_keyword(lake.silver_refs, lake.search_requests)
    return _gold(lake, G.gold_post_search_view(view, lake.silver_ai_enrichment))


@query("silver_with_keyword", """
    SELECT s.id, r.keyword, s.platform FROM silver_posts s
    LEFT JOIN search_requests r ON r.id = s.search_request_id""")
def _(lake):
    return G.silver_with_keyword(lake.silver_posts, lake.search_requests).select(
        "id", "keyword", "platform"
    )


@query("enrichment_bridge", """
    SELECT id, silver_post_id + 1000000 AS silver_post_id, ai_version, sentiment FROM enrichment""")
def _(lake):
    view = lake.silver_posts.withColumn("id", F.col("id") + 1_000_000)
    return G.enrichment_bridge(lake.silver_ai_enrichment, lake.silver_posts, view).select(
        "id", "silver_post_id", "ai_version", "sentiment"
    )


@query("enrichment_by_campaign", """
    SELECT e.id, e.sentiment, e.created_at FROM enrichment e
    JOIN silver_posts s ON s.id = e.silver_post_id
    WHERE s.search_request_id = 'sr-click' AND e.ai_version = 1""")
def _(lake):
    owner = lake.silver_posts.filter("search_request_id = 'sr-click'").select(
        F.col("id").alias("silver_post_id")
    )
    rows = G.enrichment_at(lake.silver_ai_enrichment, 1).join(owner, "silver_post_id", "left_semi")
    return newest(rows, "created_at").select("id", "sentiment", "created_at")


@query("latest_completed_job", """
    SELECT s.search_request_id, max_by(j.id, (j.completed_at, j.id)) AS enrichment_job_id
    FROM ai_jobs j JOIN silver_posts s ON s.id = j.silver_post_id
    WHERE j.status = 'completed' GROUP BY 1""")
def _(lake):
    return G.latest_completed_job(lake.ai_jobs, lake.silver_posts)


@query("latest_completed_run", """
    SELECT search_request_id, max_by(id, (completed_at, id)) AS source_crawl_run_id
    FROM crawl_runs WHERE status = 'completed' GROUP BY 1""")
def _(lake):
    return G.latest_completed_run(lake.crawl_runs)


@query("daily_keys_to_replace", f"""
    SELECT search_request_id, platform, date FROM daily
    WHERE (search_request_id, platform, date) IN (SELECT (search_request_id, platform, date)
        FROM dated WHERE created_at >= TIMESTAMP '{CUT}')""")
def _(lake):
    late = lake.gold_post_search.filter(F.col("created_at") >= ntz(CUT))
    return G.daily_keys_to_replace(lake.gold_campaign_daily, late).select(*G.DAILY_KEYS)


@query("summary_keys_to_replace", """
    SELECT search_request_id, keyword FROM summary
    WHERE search_request_id IN (SELECT search_request_id FROM gold)""")
def _(lake):
    return G.summary_keys_to_replace(lake.gold_campaign_summary, lake.gold_post_search).select(
        "search_request_id", "keyword"
    )


@query("explode_hashtags", """
    SELECT id, search_request_id, unnest(hashtags) AS hashtag FROM gold""")
def _(lake):
    return explode_hashtags(lake.gold_post_search)
