"""Registration of queries and the shared SQL the comparison statements build on."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame

from chatterlake.functions.text import WHITESPACE
from chatterlake.plans.lake import Lake

QUERIES: dict[str, Callable[[Lake], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TAG_KEY = "regexp_replace(lower(x), '^@*#*', '')"


def strip(expr: str) -> str:
    return f"trim({expr}, '{WHITESPACE}')"


def merged(own: str, found: str) -> str:
    """Order-preserving tag merge as one SQL expression."""
    tags = f"list_concat(coalesce({own}, []), {found})"
    keys = f"list_transform({tags}, lambda x: {TAG_KEY})"
    return (
        f"list_filter({tags}, lambda x, i: list_position({keys}, {TAG_KEY}) = i)"
    )


def pct(part: str, total: str, digits: int) -> str:
    scale = f"{10 ** digits}.0E0"
    return (
        f"floor(CAST({part} AS DOUBLE) / CAST(nullif({total}, 0) AS DOUBLE) * 100.0E0 * {scale}"
        f" + 0.5E0) / {scale}"
    )


def avg(value: str, digits: int) -> str:
    scale = f"{10 ** digits}.0E0"
    return (
        f"floor(CAST(sum(CAST({value} AS DECIMAL(18,6))) AS DOUBLE) / nullif(count({value}), 0)"
        f" * {scale} + 0.5E0) / {scale}"
    )


def top_list(kind: str, source: str, keys: str, n: int = 5) -> str:
    """Query for the n most frequent items per group, as one ordered list."""
    on = keys
    return f"""
        SELECT {on}, list(item ORDER BY rk) AS top_{kind}s FROM (
            SELECT *, row_number() OVER (PARTITION BY {on} ORDER BY c DESC, item) AS rk
            FROM (SELECT {on}, item, count(*) AS c FROM ({source}) GROUP BY {on}, item)
        ) WHERE rk <= {n} GROUP BY {on}"""


_HASHTAGS = "SELECT *, unnest(hashtags) AS item FROM {t}"
_TOPICS = "SELECT *, topic_label AS item FROM {t} WHERE topic_label <> ''"
_DAY = "CAST(posted_at AS DATE)"
_DAILY_KEYS = "search_request_id, platform, date"
_ORDERED_PATHS = [
    "text", "title", "selftext", "description", "author_name", "author", "channel", "uploader",
    "posted_at", "created_at", "created_utc", "upload_date", "post_url", "url", "is_retweet",
    "like_count", "share_count", "reply_count", "view_count", "public_metrics.like_count",
    "public_metrics.retweet_count", "public_metrics.reply_count",
    "public_metrics.impression_count",
]


def path(key: str) -> str:
    """Extracted payload value by key."""
    return f"nullif(x[{_ORDERED_PATHS.index(key) + 1}], '')"


def count_of(metric: str, field: str) -> str:
    first = f"nullif(CAST({path('public_metrics.' + metric)} AS BIGINT), 0)"
    second = f"nullif(CAST({path(field)} AS BIGINT), 0)"
    return f"coalesce({first}, {second}, 0)"


MEASURES = f"""max(keyword) AS keyword, count(*) AS total_posts,
    count(*) FILTER (WHERE sentiment = 'positive') AS positive_count,
    count(*) FILTER (WHERE sentiment = 'negative') AS negative_count,
    count(*) FILTER (WHERE sentiment = 'neutral') AS neutral_count,
    {avg('sentiment_confidence', 4)} AS avg_confidence,
    CAST(sum(like_count) AS BIGINT) AS total_likes,
    CAST(sum(share_count) AS BIGINT) AS total_shares,
    CAST(sum(reply_count) AS BIGINT) AS total_replies,
    CAST(sum(view_count) AS BIGINT) AS total_views,
    max(ai_version) AS ai_version"""

# Shared tables, in dependency order.
CTES: dict[str, str] = {
    "base": """
        SELECT e.event_id, e.ts, e.user_id, e.event_type, d.doc_id, d.source, d.lang,
            CAST(floor(e.value) AS BIGINT) AS v,
            CASE e.event_id % 5 WHEN 0 THEN 'twitter' WHEN 1 THEN 'reddit' WHEN 2 THEN 'youtube'
                WHEN 3 THEN 'facebook' ELSE 'instagram' END AS platform,
            'p' || CASE WHEN e.event_id % 20 = 19 THEN e.event_id - 5 ELSE e.event_id END
                AS platform_id,
            d.text || CASE WHEN e.event_id % 3 <> 0 THEN ' #' || e.event_type || ' #' || d.source
                || ' #' || upper(e.event_type) || ' @u' || e.user_id ELSE '' END AS text
        FROM events e CROSS JOIN (SELECT count(*) AS nd FROM documents) n
        JOIN documents d ON d.doc_id = e.event_id % n.nd""",
    "raw_posts": """
        SELECT event_id AS id, 'sr-' || event_type AS search_request_id,
            'cr-' || event_type || '-' || CAST(CAST(ts AS DATE) AS VARCHAR) AS crawl_run_id,
            platform, platform_id,
            CASE WHEN user_id % 10 <> 0 THEN 'u' || user_id END AS author_handle,
            CASE platform
            WHEN 'twitter' THEN CAST(json_object('text', text,
                'created_at', strftime(ts, '%Y-%m-%dT%H:%M:%S'),
                'public_metrics', json_object('like_count', v, 'retweet_count', v % 5,
                    'reply_count', v % 3, 'impression_count', v * 20)) AS VARCHAR)
            WHEN 'reddit' THEN CAST(json_object('title', substr(text, 1, 40), 'selftext', text,
                'author', 'a' || user_id, 'created_utc', epoch_us(ts) // 1000000,
                'url', 'https://r.example/' || event_id,
                'public_metrics', json_object('like_count', v, 'reply_count', v % 7)) AS VARCHAR)
            WHEN 'youtube' THEN CAST(json_object('title', substr(text, 1, 40),
                'description', text, 'channel', 'c' || user_id,
                'upload_date', strftime(ts, '%Y%m%d'), 'view_count', v * 10,
                'like_count', v) AS VARCHAR)
            ELSE CAST(json_object('text', text, 'posted_at', strftime(ts, '%Y-%m-%dT%H:%M:%S'),
                'like_count', v, 'share_count', v % 4, 'reply_count', v % 6, 'view_count', 0,
                'is_retweet', v % 2 = 0, 'hashtags', [upper(event_type), 'Data'],
                'mentions', ['@Friend']) AS VARCHAR) END AS raw_payload,
            ts AS fetched_at
        FROM base""",
    "bronze_posts": """
        SELECT * FROM raw_posts QUALIFY
            row_number() OVER (PARTITION BY platform, platform_id ORDER BY fetched_at, id) = 1""",
    "search_requests": """
        SELECT 'sr-' || event_type AS id, event_type AS keyword, DATE '2024-01-01' AS start_date,
            DATE '2024-01-30' AS end_date, 'twitter' AS platform,
            CASE WHEN event_type = 'error' THEN 'pending' ELSE 'completed' END AS status,
            count(*) AS posts_found, min(ts) AS created_at, max(ts) AS updated_at
        FROM events GROUP BY event_type
        UNION ALL SELECT 'sr-empty', 'empty', DATE '2024-01-01', DATE '2024-01-30', 'twitter',
            'completed', 0, TIMESTAMP '2024-01-02', TIMESTAMP '2024-01-02'""",
    "crawl_runs": """
        SELECT 'cr-' || event_type || '-' || CAST(d AS VARCHAR) AS id,
            'sr-' || event_type AS search_request_id, 'twitter' AS platform,
            CASE WHEN day(d) % 7 = 0 THEN 'failed' ELSE 'completed' END AS status, posts_fetched,
            CASE WHEN day(d) % 7 = 0 THEN 'E' || day(d) END AS error_message,
            started_at, completed_at
        FROM (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS posts_fetched,
                min(ts) AS started_at, max(ts) AS completed_at FROM events GROUP BY ALL)""",
    "payload": f"""
        SELECT *, json_extract_string(raw_payload,
            [{', '.join(f"'$.{p}'" for p in _ORDERED_PATHS)}]) AS x FROM bronze_posts""",
    "silver_posts": f"""
        SELECT id, id AS bronze_post_id, search_request_id, platform, platform_id, author_handle,
            coalesce({path('author_name')}, {path('author')}, {path('channel')},
                {path('uploader')}) AS author_name,
            coalesce({path('text')}, {strip(
                f"coalesce({path('title')}, '') || ' ' || "
                f"coalesce({path('selftext')}, {path('description')}, '')")}, '') AS post_text,
            coalesce(CAST({path('posted_at')} AS TIMESTAMP), CAST({path('created_at')} AS TIMESTAMP),
                make_timestamp(CAST({path('created_utc')} AS BIGINT) * 1000000),
                strptime({path('upload_date')}, '%Y%m%d')) AS posted_at,
            {count_of('like_count', 'like_count')} AS like_count,
            {count_of('retweet_count', 'share_count')} AS share_count,
            {count_of('reply_count', 'reply_count')} AS reply_count,
            {count_of('impression_count', 'view_count')} AS view_count,
            coalesce({path('post_url')}, {path('url')}) AS post_url,
            coalesce(CAST({path('is_retweet')} AS BOOLEAN), false) AS is_retweet,
            fetched_at AS created_at
        FROM payload""",
    "tagged": """
        SELECT s.*, CAST(json_extract(b.raw_payload, '$.hashtags') AS VARCHAR[]) AS own_hashtags,
            CAST(json_extract(b.raw_payload, '$.mentions') AS VARCHAR[]) AS own_mentions,
            regexp_extract_all(post_text, '#([\\p{L}\\p{N}_]+)', 1) AS text_hashtags,
            list_transform(regexp_extract_all(post_text, '@([\\p{L}\\p{N}_]+)', 1),
                lambda w: '@' || w) AS text_mentions
        FROM silver_posts s JOIN bronze_posts b USING (id)""",
    "annotations": """
        SELECT silver_post_id, topic_label, language, topic_confidence, ver AS ai_version,
            sentiment_confidence,
            CASE WHEN ver = 2 AND s1 = 'positive' THEN 'negative'
                 WHEN ver = 2 AND s1 = 'negative' THEN 'positive' ELSE s1 END AS sentiment
        FROM (
            SELECT b.event_id AS silver_post_id, b.source AS topic_label, b.lang AS language,
                (b.event_id % 50) / 50.0E0 AS topic_confidence,
                (b.event_id % 100) / 100.0E0 AS sentiment_confidence,
                CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive'
                     ELSE 'neutral' END AS s1,
                unnest(CASE WHEN b.event_id % 4 = 0 THEN [1, 2] ELSE [1] END) AS ver
            FROM base b JOIN labels l USING (doc_id))""",
    "enrichment": f"""
        SELECT 'en-' || t.id || '-' || a.ai_version AS id, t.id AS silver_post_id, a.ai_version,
            {merged('own_hashtags', 'text_hashtags')} AS hashtags,
            {merged('own_mentions', 'text_mentions')} AS mentions,
            a.language, a.topic_label, a.topic_confidence,
            CASE WHEN view_count > 0 THEN view_count
                 ELSE 10 * (like_count + share_count + reply_count) END AS reach_estimate,
            a.sentiment, a.sentiment_confidence, t.created_at
        FROM tagged t JOIN annotations a ON a.silver_post_id = t.id""",
    "ai_jobs": """
        SELECT 'job-' || id AS id, id AS silver_post_id, 'full_enrichment' AS job_type, status,
            1 AS ai_version, CAST(1 + id % 3 AS INTEGER) AS attempts, 3 AS max_attempts,
            CASE WHEN status = 'failed' THEN 'E' || (id % 3) END AS error_message,
            CASE WHEN status <> 'pending' THEN created_at END AS started_at,
            CASE WHEN status <> 'pending' THEN created_at + INTERVAL 1 MINUTE END AS completed_at,
            created_at
        FROM (SELECT s.id, s.created_at, CASE WHEN a.silver_post_id IS NOT NULL THEN 'completed'
                WHEN s.id % 2 = 0 THEN 'failed' ELSE 'pending' END AS status
            FROM silver_posts s
            LEFT JOIN annotations a ON a.silver_post_id = s.id AND a.ai_version = 1)""",
    "gold_all": """
        SELECT s.id, s.search_request_id, r.keyword, s.platform, s.author_handle, s.author_name,
            s.post_text, s.posted_at, s.post_url, e.sentiment, e.sentiment_confidence,
            e.topic_label, e.topic_confidence, e.language,
            coalesce(e.hashtags, []) AS hashtags, coalesce(e.mentions, []) AS mentions,
            s.like_count, s.share_count, s.reply_count, s.view_count,
            coalesce(e.ai_version, 1) AS ai_version, s.created_at
        FROM silver_posts s LEFT JOIN enrichment e ON e.silver_post_id = s.id
        LEFT JOIN search_requests r ON r.id = s.search_request_id""",
    "gold": """SELECT * FROM gold_all WHERE ai_version = 1""",
    "dated": f"SELECT *, {_DAY} AS date FROM gold WHERE posted_at IS NOT NULL",
    "daily": f"""
        SELECT m.*, coalesce(h.top_hashtags, []) AS top_hashtags,
            coalesce(t.top_topics, []) AS top_topics, TIMESTAMP '2024-02-01 12:00:00' AS created_at
        FROM (SELECT {_DAILY_KEYS}, {MEASURES} FROM dated GROUP BY {_DAILY_KEYS}) m
        LEFT JOIN ({top_list('hashtag', _HASHTAGS.format(t='dated'), _DAILY_KEYS)}) h
            USING (search_request_id, platform, date)
        LEFT JOIN ({top_list('topic', _TOPICS.format(t='dated'), _DAILY_KEYS)}) t
            USING (search_request_id, platform, date)""",
    "summary": f"""
        SELECT r.id AS search_request_id, r.keyword, r.start_date, r.end_date,
            coalesce(m.total_posts, 0) AS total_posts,
            {pct('positive_count', 'total_posts', 2)} AS positive_pct,
            {pct('negative_count', 'total_posts', 2)} AS negative_pct,
            {pct('neutral_count', 'total_posts', 2)} AS neutral_pct,
            m.avg_confidence,
            coalesce(total_likes + total_shares + total_replies, 0) AS total_engagement,
            coalesce(total_likes, 0) AS total_likes, coalesce(total_shares, 0) AS total_shares,
            coalesce(total_replies, 0) AS total_replies, coalesce(total_views, 0) AS total_views,
            coalesce(h.top_hashtags, []) AS top_hashtags,
            coalesce(t.top_topics, []) AS top_topics, coalesce(p.platforms, []) AS platforms,
            coalesce(m.ai_version, 1) AS ai_version, TIMESTAMP '2024-02-01 12:00:00' AS created_at
        FROM search_requests r
        LEFT JOIN (SELECT search_request_id, {MEASURES} FROM gold GROUP BY 1) m
            ON m.search_request_id = r.id
        LEFT JOIN ({top_list('hashtag', _HASHTAGS.format(t='gold'), 'search_request_id')}) h
            ON h.search_request_id = r.id
        LEFT JOIN ({top_list('topic', _TOPICS.format(t='gold'), 'search_request_id')}) t
            ON t.search_request_id = r.id
        LEFT JOIN (SELECT search_request_id, list_sort(list(DISTINCT platform)) AS platforms
            FROM gold GROUP BY 1) p ON p.search_request_id = r.id""",
    "tracking": """
        SELECT 'sr-' || event_type AS search_request_id, TIMESTAMP '2024-01-20' AS last_built_at,
            count(*) AS posts_processed
        FROM events WHERE event_type IN ('click', 'view') AND ts <= TIMESTAMP '2024-01-20'
        GROUP BY event_type""",
    "token_events": """
        SELECT e.event_id AS id, e.ts,
            CASE WHEN coalesce(length(d.text), 0) = 0 THEN 0
                 ELSE greatest(1, length(d.text) // 4) END AS tokens
        FROM events e CROSS JOIN (SELECT count(*) AS nd FROM documents) n
        JOIN documents d ON d.doc_id = e.event_id % n.nd""",
}


def with_tables(body: str) -> str:
    """Prefix a statement with the shared tables it uses, directly or through one another."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(body)
    if not needed:
        return body
    parts = [f"{n} AS ({CTES[n]})" for n in CTES if n in needed]
    own = body.strip()
    if own.startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + own[len("WITH RECURSIVE "):]
    if own.startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + own[len("WITH "):]
    return "WITH " + ",\n".join(parts) + "\n" + own


def query(name: str, sql: str | None = None):
    """Register a query under ``name``, with the statement that gives the same rows."""
    def register(run: Callable[[Lake], DataFrame]):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_tables(sql)
        return run

    return register
