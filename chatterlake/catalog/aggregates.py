"""Aggregates, rankings and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlake.catalog.ingest import COUNTED, LAYER_COUNTS
from chatterlake.catalog.registry import avg, pct, query, top_list
from chatterlake.functions.times import ntz
from chatterlake.operators import budget as B
from chatterlake.operators import enrich as K
from chatterlake.operators import gold as G
from chatterlake.operators import lifecycle as L
from chatterlake.operators import serve as V
from chatterlake.plans.lake import BUILT_AT

LISTS = """array_to_string(top_hashtags, ',') AS top_hashtags,
    array_to_string(top_topics, ',') AS top_topics"""


def joined_lists(df, *names):
    return df.withColumns({n: F.array_join(n, ",") for n in names})


@query("campaign_daily", f"SELECT * EXCLUDE (top_hashtags, top_topics), {LISTS} FROM daily")
def campaign_daily(lake):
    return joined_lists(G.campaign_daily(lake.gold_post_search, at=ntz(BUILT_AT)), "top_hashtags", "top_topics")


@query("campaign_summary", f"""
    SELECT * EXCLUDE (top_hashtags, top_topics, platforms), {LISTS},
        array_to_string(platforms, ',') AS platforms FROM summary""")
def _(lake):
    rows = G.campaign_summary(lake.gold_post_search, lake.search_requests, at=ntz(BUILT_AT))
    return joined_lists(rows, "top_hashtags", "top_topics", "platforms")


def _sql_measures(conf: str = "coalesce(sentiment_confidence, 0)") -> str:
    return f"""count(*) AS total_posts,
        count(*) FILTER (WHERE sentiment = 'positive') AS positive_count,
        count(*) FILTER (WHERE sentiment = 'negative') AS negative_count,
        count(*) FILTER (WHERE sentiment = 'neutral') AS neutral_count,
        {avg(conf, 4)} AS avg_confidence,
        CAST(sum(like_count) AS BIGINT) AS total_likes,
        CAST(sum(share_count) AS BIGINT) AS total_shares,
        CAST(sum(reply_count) AS BIGINT) AS total_replies,
        CAST(sum(view_count) AS BIGINT) AS total_views, max(ai_version) AS ai_version,
        CAST(sum(len(hashtags)) AS BIGINT) AS hashtag_count,
        count(*) FILTER (WHERE topic_label <> '') AS topic_count"""


# Gold with every version and with some posts that carry no time.
_MIXED = """(SELECT * EXCLUDE (posted_at),
    CASE WHEN id % 50 <> 0 THEN posted_at END AS posted_at FROM gold_all)"""


def _mixed(lake):
    view = G.silver_with_keyword(lake.silver_posts, lake.search_requests)
    posts = G.gold_post_search_view(view, lake.silver_ai_enrichment)
    return posts.withColumn("posted_at", F.when(F.col("id") % 50 != 0, F.col("posted_at")))


@query("campaign_daily_sql", f"""
    SELECT search_request_id, keyword, platform, CAST(posted_at AS DATE) AS date,
        {_sql_measures()}, array_to_string(list_sort(flatten(list(hashtags))), ',') AS top_hashtags,
        coalesce(array_to_string(list_sort(list(topic_label) FILTER (topic_label <> '')), ','), '')
            AS top_topics
    FROM {_MIXED} GROUP BY ALL""")
def _(lake):
    return joined_lists(G.campaign_daily_sql(_mixed(lake)), "top_hashtags", "top_topics")


_KIND_COUNTS = """
    SELECT {keys}, kind, item, count(*) AS count FROM (
        SELECT *, 'hashtag' AS kind, unnest(hashtags) AS item FROM {t}
        UNION ALL SELECT *, 'topic', topic_label FROM {t} WHERE topic_label <> '')
    GROUP BY ALL"""


@query("campaign_daily_sql_items", _KIND_COUNTS.format(
    keys="search_request_id, keyword, platform, CAST(posted_at AS DATE) AS date", t=_MIXED))
def _(lake):
    dated = _mixed(lake).withColumn("date", F.to_date("posted_at"))
    return G.tag_counts(dated, ["search_request_id", "keyword", "platform", "date"])


@query("campaign_summary_sql", f"""
    WITH m AS (SELECT search_request_id, keyword, CAST(min(posted_at) AS DATE) AS start_date,
        CAST(max(posted_at) AS DATE) AS end_date, {_sql_measures()},
        array_to_string(list_sort(list(DISTINCT platform)), ',') AS platforms
        FROM {_MIXED} GROUP BY search_request_id, keyword)
    SELECT search_request_id, keyword, start_date, end_date, total_posts,
        {pct('positive_count', 'total_posts', 2)} AS positive_pct,
        {pct('negative_count', 'total_posts', 2)} AS negative_pct,
        {pct('neutral_count', 'total_posts', 2)} AS neutral_pct, avg_confidence,
        total_likes + total_shares + total_replies AS total_engagement,
        total_likes, total_shares, total_replies, total_views, hashtag_count, topic_count,
        platforms, ai_version FROM m""")
def _(lake):
    return joined_lists(G.campaign_summary_sql(_mixed(lake)), "platforms")


@query("campaign_summary_sql_items",
       _KIND_COUNTS.format(keys="search_request_id, keyword", t=_MIXED))
def _(lake):
    return G.tag_counts(_mixed(lake), ["search_request_id", "keyword"])


@query("sentiment_breakdown", """
    SELECT keyword, coalesce(sentiment, 'unknown') AS sentiment, count(*) AS count
    FROM gold GROUP BY ALL""")
def _(lake):
    return V.sentiment_breakdown(lake.gold_post_search)


@query("sentiment_distribution", """
    SELECT search_request_id, sentiment, count(*) AS count FROM gold
    WHERE sentiment IS NOT NULL GROUP BY ALL""")
def _(lake):
    return V.sentiment_distribution(lake.gold_post_search)


@query("daily_volume", """
    SELECT search_request_id, date, count(*) AS count FROM dated GROUP BY ALL""")
def _(lake):
    return V.daily_volume(lake.gold_post_search)


def _top_sql(kind: str, source: str) -> str:
    return f"""
        SELECT search_request_id, item AS {kind}, c AS count, rk AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY search_request_id ORDER BY c DESC, item)
                AS rk
            FROM (SELECT search_request_id, item, count(*) AS c FROM ({source}) GROUP BY ALL))
        WHERE rk <= 10"""


TOP_HASHTAGS = _top_sql("hashtag", "SELECT search_request_id, unnest(hashtags) AS item FROM gold")
TOP_TOPICS = _top_sql("topic", """SELECT search_request_id, topic_label AS item FROM gold
    WHERE topic_label IS NOT NULL""")


@query("top_hashtags", TOP_HASHTAGS)
def _(lake):
    return V.top_items(lake.gold_post_search, "hashtag")


@query("top_topics", TOP_TOPICS)
def _(lake):
    return V.top_items(lake.gold_post_search, "topic")


@query("top_n_per_group", f"""
    SELECT platform, array_to_string(top_hashtags, ',') AS top_hashtags,
        array_to_string(top_topics, ',') AS top_topics
    FROM ({top_list('hashtag', 'SELECT *, unnest(hashtags) AS item FROM gold', 'platform')})
    JOIN ({top_list('topic', "SELECT *, topic_label AS item FROM gold WHERE topic_label <> ''",
                    'platform')}) USING (platform)""")
def _(lake):
    return joined_lists(
        G.top_lists(lake.gold_post_search, ["platform"]), "top_hashtags", "top_topics"
    )


STATS = f"""
    SELECT search_request_id, max(keyword) AS keyword, min(platform) AS platform,
        count(*) AS total_posts,
        {pct("count(*) FILTER (sentiment = 'positive')", 'count(*)', 1)} AS positive_pct,
        {pct("count(*) FILTER (sentiment = 'negative')", 'count(*)', 1)} AS negative_pct,
        {pct("count(*) FILTER (sentiment = 'neutral')", 'count(*)', 1)} AS neutral_pct,
        coalesce({avg('sentiment_confidence', 3)}, 0) AS avg_confidence,
        CAST(sum(like_count) AS BIGINT) AS total_likes,
        CAST(sum(share_count) AS BIGINT) AS total_shares,
        CAST(sum(reply_count) AS BIGINT) AS total_replies,
        CAST(sum(view_count) AS BIGINT) AS total_views
    FROM gold GROUP BY search_request_id"""


@query("campaign_stats", STATS)
def _(lake):
    return V.campaign_stats(lake.gold_post_search)


@query("count_by", """
    SELECT 'gold' AS what, keyword AS key, count(*) AS count FROM gold GROUP BY ALL
    UNION ALL SELECT 'silver', search_request_id, count(*) FROM silver_posts GROUP BY ALL
    UNION ALL SELECT 'bronze', search_request_id, count(*) FROM bronze_posts GROUP BY ALL""")
def _(lake):
    parts = [("gold", lake.gold_post_search, "keyword"),
             ("silver", lake.silver_posts, "search_request_id"),
             ("bronze", lake.bronze_posts, "search_request_id")]
    return V.union_all([
        V.count_by(df, F.col(key).alias("key")).select(F.lit(what).alias("what"), "key", "count")
        for what, df, key in parts
    ])


@query("max_ai_version", """
    SELECT s.id, coalesce(max(e.ai_version), 0) AS max_version,
        coalesce(max(e.ai_version), 0) + 1 AS next_version
    FROM silver_posts s LEFT JOIN enrichment e ON e.silver_post_id = s.id GROUP BY s.id""")
def _(lake):
    return K.max_ai_version(lake.silver_posts, lake.silver_ai_enrichment)


@query("platforms_of_campaign", """
    SELECT search_request_id, array_to_string(list_sort(list(DISTINCT platform)), ',')
        AS platforms FROM gold GROUP BY 1""")
def _(lake):
    return joined_lists(G.platforms_of_campaign(lake.gold_post_search), "platforms")


@query("volume_trend", "SELECT keyword, platform, date, total_posts FROM daily")
def _(lake):
    return V.volume_trend(lake.gold_campaign_daily)


@query("table_row_counts", LAYER_COUNTS)
def _(lake):
    return V.table_row_counts(lake.layers(*COUNTED))


@query("run_metrics", """
    WITH r AS (SELECT count(*) AS started, count(*) FILTER (status = 'completed') AS completed,
            count(*) FILTER (status = 'failed') AS failed,
            CAST(sum(posts_fetched) AS BIGINT) AS fetched FROM crawl_runs),
    j AS (SELECT count(*) FILTER (status <> 'pending') AS started,
            count(*) FILTER (status = 'completed') AS completed,
            count(*) FILTER (status = 'failed') AS failed FROM ai_jobs)
    SELECT 'crawls_started' AS counter, started AS value FROM r
    UNION ALL SELECT 'crawls_completed', completed FROM r
    UNION ALL SELECT 'crawls_failed', failed FROM r
    UNION ALL SELECT 'posts_fetched', fetched FROM r
    UNION ALL SELECT 'enrichments_started', started FROM j
    UNION ALL SELECT 'enrichments_completed', completed FROM j
    UNION ALL SELECT 'enrichments_failed', failed FROM j
    UNION ALL SELECT 'gold_builds_completed', count(*) FROM tracking
    UNION ALL SELECT 'error:' || error_message, count(*) FROM (
        SELECT error_message FROM crawl_runs UNION ALL SELECT error_message FROM ai_jobs)
        WHERE error_message IS NOT NULL GROUP BY error_message""")
def _(lake):
    return L.run_metrics(lake.crawl_runs, lake.ai_jobs, lake.gold_build_tracking)


USAGE = """
    SELECT hour, hour_tokens, CAST(sum(hour_tokens) OVER (PARTITION BY CAST(hour AS DATE)
            ORDER BY hour ROWS UNBOUNDED PRECEDING) AS BIGINT) AS day_tokens
    FROM (SELECT date_trunc('hour', ts) AS hour, CAST(sum(tokens) AS BIGINT) AS hour_tokens
        FROM token_events GROUP BY 1)"""


@query("token_usage", f"""
    SELECT *, hour_tokens > 10000 AS over_hourly, day_tokens > 150000 AS over_daily
    FROM ({USAGE})""")
def _(lake):
    return B.token_usage(lake.token_events, hourly=10_000, daily=150_000)


_FITS = "{h} + s.tokens <= 4000 AND {d} + s.tokens <= 60000"
_SAME = "CASE WHEN s.h = r.h THEN r.hour_after ELSE 0 END"


@query("budget_decisions", f"""
    WITH RECURSIVE s AS (
        SELECT id, tokens, CAST(ts AS DATE) AS d, date_trunc('hour', ts) AS h,
            row_number() OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, id) AS rn FROM token_events),
    r AS (
        SELECT id, d, h, rn, {_FITS.format(h=0, d=0)} AS allowed, CAST(0 AS BIGINT) AS hour_used, CAST(0 AS BIGINT) AS day_used,
            CAST(CASE WHEN {_FITS.format(h=0, d=0)} THEN tokens ELSE 0 END AS BIGINT) AS hour_after,
            CAST(CASE WHEN {_FITS.format(h=0, d=0)} THEN tokens ELSE 0 END AS BIGINT) AS day_after
        FROM s WHERE rn = 1
        UNION ALL
        SELECT s.id, s.d, s.h, s.rn, {_FITS.format(h=_SAME, d='r.day_after')}, {_SAME}, r.day_after,
            CAST({_SAME} + CASE WHEN {_FITS.format(h=_SAME, d='r.day_after')} THEN s.tokens ELSE 0 END AS BIGINT),
            CAST(r.day_after + CASE WHEN {_FITS.format(h=_SAME, d='r.day_after')} THEN s.tokens ELSE 0 END AS BIGINT)
        FROM r JOIN s ON s.d = r.d AND s.rn = r.rn + 1)
    SELECT id, allowed, hour_used, day_used FROM r""")
def _(lake):
    """What each call finds when it asks: the budgets are such that some days fit and others do not."""
    return B.budget_decisions(lake.token_events, hourly=4_000, daily=60_000).select(
        "id", "allowed", "hour_used", "day_used")


@query("enrich_outcome", """
    SELECT ai_version, count(*) FILTER (status = 'completed') AS enriched,
        count(*) FILTER (status = 'failed') AS failed FROM ai_jobs GROUP BY 1""")
def _(lake):
    return K.enrich_outcome(lake.ai_jobs)


# --- windows -------------------------------------------------------------------------------


@query("latest_enrichment", """
    SELECT silver_post_id, ai_version, sentiment FROM enrichment
    QUALIFY row_number() OVER (PARTITION BY silver_post_id ORDER BY ai_version DESC) = 1""")
def _(lake):
    return G.latest_enrichment(lake.silver_ai_enrichment).select(
        "silver_post_id", "ai_version", "sentiment"
    )


@query("rank_items", """
    SELECT language, kind, item, count, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY language, kind ORDER BY count DESC, item)
            AS rank
        FROM (SELECT language, kind, item, count(*) AS count FROM (
            SELECT language, 'hashtag' AS kind, unnest(hashtags) AS item FROM gold
            UNION ALL SELECT language, 'topic', topic_label FROM gold WHERE topic_label <> '')
            GROUP BY ALL))
    WHERE rank <= 7""")
def _(lake):
    keys = ["language"]
    return G.rank_items(G.tag_counts(lake.gold_post_search, keys), keys, 7)


@query("running_tokens", """
    SELECT id, CAST(sum(tokens) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, id
        ROWS UNBOUNDED PRECEDING) AS BIGINT) AS day_tokens FROM token_events""")
def _(lake):
    events = lake.token_events.withColumn("day", F.to_date("ts"))
    return B.running_total(events, "day", ["ts", "id"], "tokens", "day_tokens").select(
        "id", "day_tokens"
    )


@query("recent_per_campaign", """
    SELECT search_request_id, id, posted_at, rank FROM (
        SELECT *, row_number() OVER (PARTITION BY search_request_id
            ORDER BY posted_at DESC NULLS LAST, id) AS rank FROM gold)
    WHERE rank <= 20""")
def _(lake):
    posts = lake.gold_post_search.select("search_request_id", "id", "posted_at")
    return V.recent_per_campaign(posts, 20)
