"""Sorted lists, pages, reshaping and composite read models."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlake.catalog.aggregates import STATS, TOP_HASHTAGS, TOP_TOPICS
from chatterlake.catalog.registry import query
from chatterlake.operators import serve as V

PAGE = "posted_at DESC NULLS LAST, id"
IDS = ["sr-click", "sr-view", "sr-error", "sr-missing"]
_ID_LIST = "('sr-click', 'sr-view', 'sr-error', 'sr-missing')"

CARD = """coalesce(nullif(author_handle, ''), nullif(author_name, ''), 'Unknown') AS author,
    md5(coalesce(post_text, '')) AS text_md5, coalesce(sentiment, 'unknown') AS sentiment,
    floor(coalesce(sentiment_confidence, 0) * 100.0E0 + 0.5E0) / 100.0E0 AS confidence,
    coalesce(strftime(posted_at, '%Y-%m-%d'), '') AS date, like_count AS likes,
    share_count AS shares, reply_count AS replies, platform,
    coalesce(topic_label, '') AS topic, coalesce(language, '') AS language"""


def _short(df):
    return df.withColumn("text_md5", F.md5("text")).drop("text")


@query("post_card", f"SELECT id, {CARD} FROM gold")
def _(lake):
    return _short(lake.gold_post_search.select("id", *V.post_card()))


@query("posts_by_keyword", f"""
    SELECT id, posted_at FROM gold WHERE keyword = 'signup' ORDER BY {PAGE}
    LIMIT 100 OFFSET 20""")
def _(lake):
    return V.filter_posts(
        lake.gold_post_search, "signup", limit=100, offset=20, requests=lake.search_requests
    ).select(
        "id", "posted_at"
    )


@query("posts_by_campaign", "SELECT id, posted_at FROM gold WHERE search_request_id = 'sr-view'")
def _(lake):
    posts = V.lookup(lake.gold_post_search, search_request_id="sr-view")
    return V.newest(posts, "posted_at").select("id", "posted_at")


@query("daily_by_campaign", """
    SELECT platform, date, total_posts FROM daily WHERE search_request_id = 'sr-view'""")
def _(lake):
    rows = V.lookup(lake.gold_campaign_daily, search_request_id="sr-view")
    return rows.orderBy("date", "platform").select("platform", "date", "total_posts")


@query("recent_requests", """
    SELECT id, keyword, status, created_at FROM search_requests
    ORDER BY created_at DESC, id LIMIT 20""")
def _(lake):
    return V.newest(lake.search_requests, "created_at", 20).select(
        "id", "keyword", "status", "created_at"
    )


@query("recent_jobs", """
    SELECT substr(id, 1, 8) AS short_id, job_type, status, created_at FROM ai_jobs
    ORDER BY created_at DESC, id LIMIT 5""")
def _(lake):
    return V.newest(lake.ai_jobs, "created_at", 5).select(
        F.substring("id", 1, 8).alias("short_id"), "job_type", "status", "created_at"
    )


@query("all_summaries", """
    SELECT search_request_id, keyword, total_posts, created_at FROM summary""")
def _(lake):
    return V.newest(lake.gold_campaign_summary, "created_at", tie="search_request_id").select(
        "search_request_id", "keyword", "total_posts", "created_at"
    )


@query("all_builds", "SELECT search_request_id, last_built_at, posts_processed FROM tracking")
def _(lake):
    return V.newest(lake.gold_build_tracking, "last_built_at", tie="search_request_id")


@query("page_bounds", """
    SELECT search_request_id, greatest(1, (total_posts + 49) // 50) AS pages,
        CAST(100 AS BIGINT) AS row_offset FROM summary""")
def _(lake):
    bounds = V.page_bounds(F.col("total_posts"), F.lit(3), 50)
    return lake.gold_campaign_summary.select(
        "search_request_id", *[c.alias(n) for n, c in bounds.items()]
    )


@query("campaigns", """
    SELECT DISTINCT search_request_id, keyword, platform,
        keyword || ' (' || platform || ')' AS label FROM gold""")
def _(lake):
    return V.campaigns(lake.gold_post_search)


ANALYTICS = f"""
    SELECT search_request_id, keyword, CASE WHEN len(platforms) = 0 THEN 'unknown'
            ELSE array_to_string(platforms, ', ') END AS platform, total_posts,
        coalesce(positive_pct, 0) AS positive_pct, coalesce(negative_pct, 0) AS negative_pct,
        coalesce(neutral_pct, 0) AS neutral_pct, coalesce(avg_confidence, 0) AS avg_confidence,
        total_likes, total_shares, total_replies, total_views
    FROM summary WHERE keyword <> 'view'
    UNION ALL SELECT search_request_id, keyword, platform, total_posts, positive_pct,
        negative_pct, neutral_pct, avg_confidence, total_likes, total_shares, total_replies,
        total_views
    FROM ({STATS}) WHERE keyword = 'view'"""


def _summary(lake):
    """Summaries of all campaigns but one, whose figures must come from its posts."""
    return lake.gold_campaign_summary.filter("keyword <> 'view'")


def _analytics(lake):
    return V.campaign_analytics(_summary(lake), lake.gold_post_search)


@query("campaign_analytics", ANALYTICS)
def _(lake):
    return _analytics(lake)


@query("campaign_analytics_hashtags", f"""
    SELECT search_request_id, unnest(top_hashtags) AS hashtag, 0 AS count,
        unnest(range(1, len(top_hashtags) + 1)) AS rank FROM summary WHERE keyword <> 'view'
    UNION ALL SELECT search_request_id, hashtag, count, rank FROM ({TOP_HASHTAGS})
    WHERE search_request_id = 'sr-view'""")
def _(lake):
    return V.campaign_items(_summary(lake), lake.gold_post_search, "hashtag")


@query("campaign_analytics_topics", f"""
    SELECT search_request_id, unnest(top_topics) AS topic, 0 AS count,
        unnest(range(1, len(top_topics) + 1)) AS rank FROM summary WHERE keyword <> 'view'
    UNION ALL SELECT search_request_id, topic, count, rank FROM ({TOP_TOPICS})
    WHERE search_request_id = 'sr-view'""")
def _(lake):
    return V.campaign_items(_summary(lake), lake.gold_post_search, "topic")


@query("cross_campaign_union", f"""
    SELECT * FROM ({ANALYTICS}) WHERE search_request_id IN {_ID_LIST}""")
def _(lake):
    return V.only(_analytics(lake), IDS)


@query("cross_campaign_sentiment", f"""
    SELECT search_request_id, keyword AS campaign, positive_pct AS positive, negative_pct AS negative,
        neutral_pct AS neutral FROM ({ANALYTICS}) WHERE search_request_id IN {_ID_LIST}""")
def _(lake):
    return V.sentiment_comparison(_analytics(lake), IDS)


@query("cross_campaign_volume", f"""
    SELECT search_request_id, keyword AS campaign, date, count(*) AS count FROM dated
    WHERE search_request_id IN {_ID_LIST} GROUP BY ALL""")
def _(lake):
    return V.volume_comparison(_analytics(lake), lake.gold_post_search, IDS)


@query("cross_campaign_engagement", f"""
    SELECT search_request_id, keyword AS campaign, total_likes AS likes, total_shares AS shares,
        total_replies AS replies, total_views AS views
    FROM ({ANALYTICS}) WHERE search_request_id IN {_ID_LIST}""")
def _(lake):
    return V.engagement_comparison(_analytics(lake), IDS)


@query("cross_campaign", f"""
    SELECT search_request_id, keyword AS campaign, positive_pct AS positive, negative_pct AS negative,
        neutral_pct AS neutral, total_likes AS likes, total_shares AS shares,
        total_replies AS replies, total_views AS views, v.days, v.posts
    FROM ({ANALYTICS}) a JOIN (SELECT search_request_id, count(DISTINCT date) AS days,
        count(*) AS posts FROM dated GROUP BY 1) v USING (search_request_id)
    WHERE search_request_id IN {_ID_LIST}""")
def _(lake):
    analytics = _analytics(lake)
    volume = V.volume_comparison(analytics, lake.gold_post_search, IDS).groupBy("search_request_id").agg(
        F.count("date").alias("days"), F.sum("count").alias("posts")
    )
    return (
        V.sentiment_comparison(analytics, IDS)
        .join(V.engagement_comparison(analytics, IDS).drop("campaign"), "search_request_id")
        .join(volume, "search_request_id")
    )


@query("comparison_table", f"""
    SELECT search_request_id, keyword AS campaign, platform, total_posts, positive_pct, negative_pct, neutral_pct,
        floor(avg_confidence * 1000.0E0 + 0.5E0) / 1000.0E0 AS avg_confidence,
        total_likes AS likes, total_shares AS shares, total_replies AS replies,
        total_views AS views FROM ({ANALYTICS})""")
def _(lake):
    return V.comparison_table(_analytics(lake))


@query("melt_metrics", f"""
    SELECT search_request_id, campaign, metric, CAST(value AS DOUBLE) AS value FROM (
        SELECT search_request_id, keyword AS campaign, total_likes AS likes, total_shares AS shares,
            total_replies AS replies, total_views AS views FROM ({ANALYTICS}))
    UNPIVOT (value FOR metric IN (likes, shares, replies, views))""")
def _(lake):
    return V.melt_metrics(
        V.engagement_comparison(_analytics(lake)), ["search_request_id", "campaign"],
        ["likes", "shares", "replies", "views"],
    )


@query("post_explorer", f"""
    WITH hits AS (SELECT * FROM gold WHERE post_text ILIKE '%an%' AND sentiment = 'positive'
        AND platform = 'reddit')
    SELECT id, {CARD}, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY {PAGE} LIMIT 50""")
def _(lake):
    return _short(V.post_explorer(
        lake.gold_refs, 50, 0, lake.fresh("explorer"), read=lake.with_texts, read_page=lake.with_texts_of,
        keyword="an", sentiment="positive", platform="reddit",
    ))


