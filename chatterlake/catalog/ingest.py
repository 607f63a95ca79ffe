"""Sources, raw payloads, silver extraction and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlake.catalog.registry import merged, query, strip
from chatterlake.functions import numbers as N
from chatterlake.functions import text as X
from chatterlake.functions import times as T
from chatterlake.operators import gold as G
from chatterlake.operators import silver as S
from chatterlake.operators.serve import union_all
from chatterlake.plans.export import export_layers, write_gold_partitioned
from chatterlake.plans.lake import LAYERS, VIEWS
from chatterlake.plans.views import publish_views
from chatterlake.schemas import TABLES
from chatterlake.sources import normalise, seed
from chatterlake.sources.payload import read_raw_payload, with_payload
from chatterlake.sources.tables import scan_layer
from chatterlake.storage import write_table

START, END = "2024-01-05", "2024-01-25"


def _text(c):
    return F.col(c).cast("string")


# --- stored layers -------------------------------------------------------------------------


@query("scan_layer", """
    SELECT id, search_request_id, crawl_run_id, platform, platform_id, author_handle, fetched_at,
        length(raw_payload) AS payload_chars FROM bronze_posts""")
def _(lake):
    lake.stored("bronze_posts")
    rows = scan_layer(lake.spark, lake.folder("bronze_posts"), "bronze_posts")
    return rows.withColumn("payload_chars", F.length("raw_payload")).drop("raw_payload")


_SQL_TABLES = {"gold_post_search": "gold", "silver_ai_enrichment": "enrichment",
               "gold_build_tracking": "tracking", "gold_campaign_daily": "daily",
               "gold_campaign_summary": "summary"}
_NO_SQL = [f"{kind}_model_{what}" for kind in ("metadata", "sentiment") for what in ("name", "version")]


@query("scan_layers", " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{c}' AS column_name, count({c}) AS filled"
    f" FROM {_SQL_TABLES.get(table, table)}"
    for table, columns in TABLES.items() for c in columns if c not in _NO_SQL))
def _(lake):
    """Filled values of every column of the ten stored layers."""
    parts = []
    for table, columns in TABLES.items():
        lake.stored(table)
        names = [c for c in columns if c not in _NO_SQL]
        counts = scan_layer(lake.spark, lake.folder(table), table).agg(*[F.count(c).alias(c) for c in names])
        parts.append(counts.unpivot([], names, "column_name", "filled")
                     .withColumn("table_name", F.lit(table)))
    return union_all(parts)


@query("read_raw_payload", """
    SELECT id, x[1] IS NULL AS text_is_null, md5(coalesce(x[1], x[3], x[4])) AS body_md5,
        x[2] AS title, x[6] AS author, x[7] AS channel, x[9] AS posted_at, x[11] AS created_utc,
        x[12] AS upload_date, x[14] AS url, x[16] AS like_count, x[20] AS metric_likes
    FROM payload""")
def _(lake):
    p = read_raw_payload(lake.bronze_posts)
    return p.select(
        "id", F.col("text").isNull().alias("text_is_null"),
        F.md5(F.coalesce("text", "selftext", "description")).alias("body_md5"),
        "title", "author", "channel", "posted_at", "created_utc", "upload_date", "url",
        "like_count", F.col("public_metrics.like_count").alias("metric_likes"),
    )


# --- native API items ----------------------------------------------------------------------


def _range(df):
    return df.withColumns({"start_date": T.day(START), "end_date": T.day(END)})


def _reddit_pages(base):
    """Listing pages of a fixed size, with missing ids, times and links among the entries."""
    e = F.col("event_id")
    item = F.to_json(F.struct(
        F.concat(F.lit("t3_"), _text("event_id")).alias("name"),
        F.when(e % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("r"), _text("event_id")))
        .alias("id"),
        F.concat_ws(" ", "source", "lang").alias("title"), F.col("text").alias("selftext"),
        F.concat(F.lit("a"), _text("user_id")).alias("author"),
        F.when(e % 13 == 0, F.lit("")).otherwise(F.concat(F.lit("/r/x/"), _text("event_id")))
        .alias("permalink"),
        F.concat(F.lit("https://r.example/"), _text("event_id")).alias("url"),
        F.col("v").alias("score"), (F.col("v") % 7).alias("num_comments"),
        F.when(e % 11 == 0, F.lit(0)).otherwise(seed.epoch_seconds(F.col("ts")))
        .alias("created_utc"),
    ))
    page = F.concat(
        F.lit('{"data": {"children": ['),
        F.array_join(F.collect_list(
            F.concat(F.lit('{"kind": "t3", "data": '), item, F.lit("}"))), ","),
        F.lit("]}}"),
    )
    return base.groupBy(F.floor(e / seed.PAGE_SIZE).alias("page_no")).agg(page.alias("page"))


@query("normalize_reddit", f"""
    SELECT CASE WHEN event_id % 7 = 0 THEN 't3_' || event_id ELSE 'r' || event_id END
            AS platform_id,
        'a' || user_id AS author_handle, md5({strip("source || ' ' || lang || ' ' || text")})
            AS text_md5,
        strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS posted_at,
        CASE WHEN event_id % 13 = 0 THEN '' ELSE 'https://www.reddit.com/r/x/' || event_id END
            AS post_url,
        v AS likes, v % 7 AS replies
    FROM base WHERE event_id % 11 <> 0
        AND CAST(ts AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'""")
def _(lake):
    pages = _reddit_pages(lake.base())
    rows = normalise.normalize_reddit(_range(normalise.explode_listing(pages)).drop("page_no"))
    p = F.from_json("raw_payload", """text string, posted_at string, post_url string,
        public_metrics struct<like_count: bigint, reply_count: bigint>""")
    return rows.withColumn("p", p).select(
        "platform_id", "author_handle", F.md5("p.text").alias("text_md5"), "p.posted_at",
        "p.post_url", F.col("p.public_metrics.like_count").alias("likes"),
        F.col("p.public_metrics.reply_count").alias("replies"),
    )


def _youtube_item():
    e = F.col("event_id")
    return F.to_json(F.struct(
        F.when(e % 17 == 0, F.lit("")).otherwise(F.concat(F.lit("v"), _text("event_id")))
        .alias("id"),
        F.col("source").alias("title"), F.when(e % 9 != 0, F.col("text")).alias("description"),
        F.when(e % 4 == 0, F.lit("")).otherwise(F.concat(F.lit("c"), _text("user_id")))
        .alias("channel"),
        F.concat(F.lit("up"), _text("user_id")).alias("uploader"),
        F.concat(F.lit("https://v.example/"), _text("event_id")).alias("webpage_url"),
        F.when(e % 10 == 0, F.lit("")).when(e % 10 == 1, F.lit("20241399"))
        .otherwise(F.date_format("ts", "yyyyMMdd")).alias("upload_date"),
        (F.col("v") * 10).alias("view_count"),
        F.when(e % 6 != 0, F.col("v")).alias("like_count"), (F.col("v") % 5).alias("comment_count"),
    ))


@query("normalize_youtube", f"""
    SELECT 'v' || event_id AS platform_id,
        CASE WHEN event_id % 4 = 0 THEN 'up' || user_id ELSE 'c' || user_id END AS author_handle,
        md5({strip("source || ' ' || CASE WHEN event_id % 9 <> 0 THEN text ELSE '' END")})
            AS text_md5,
        strftime(ts, '%Y-%m-%d') || 'T00:00:00+00:00' AS posted_at,
        'https://v.example/' || event_id AS post_url,
        CASE WHEN event_id % 6 <> 0 THEN v ELSE 0 END AS likes, v * 10 AS views, v % 5 AS replies
    FROM base WHERE event_id % 17 <> 0 AND event_id % 10 NOT IN (0, 1)
        AND CAST(ts AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'""")
def _(lake):
    items = lake.base().select(_youtube_item().alias("item"))
    rows = normalise.normalize_youtube(_range(items))
    p = F.from_json("raw_payload", """text string, posted_at string, post_url string,
        public_metrics struct<like_count: bigint, view_count: bigint, reply_count: bigint>""")
    return rows.withColumn("p", p).select(
        "platform_id", "author_handle", F.md5("p.text").alias("text_md5"), "p.posted_at",
        "p.post_url", F.col("p.public_metrics.like_count").alias("likes"),
        F.col("p.public_metrics.view_count").alias("views"),
        F.col("p.public_metrics.reply_count").alias("replies"),
    )


def _tweet_item():
    return F.to_json(F.struct(
        F.concat(F.lit("t"), _text("event_id")).alias("id"), "text",
        F.concat(F.lit("u"), _text("user_id")).alias("author_id"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "lang",
        F.struct(F.col("v").alias("like_count")).alias("public_metrics"),
    ))


@query("normalize_tweets", """
    SELECT 't' || event_id AS platform_id, 'u' || user_id AS author_handle,
        md5(text) AS text_md5, v AS likes FROM base""")
def _(lake):
    pages = lake.base().groupBy(F.floor(F.col("event_id") / seed.PAGE_SIZE)).agg(
        F.concat(F.lit('{"data": ['), F.array_join(F.collect_list(_tweet_item()), ","),
                 F.lit("]}")).alias("page")
    ).select("page")
    rows = normalise.normalize_tweets(_range(normalise.explode_listing(pages, "data[]")))
    p = F.from_json(
        "raw_payload", "text string, public_metrics struct<like_count: bigint>"
    )
    return rows.withColumn("p", p).select(
        "platform_id", "author_handle", F.md5("p.text").alias("text_md5"),
        F.col("p.public_metrics.like_count").alias("likes"),
    )


@query("route_by_platform", f"""
    SELECT platform,
        CASE platform WHEN 'youtube' THEN 'v' || event_id WHEN 'reddit' THEN 'r' || event_id
             ELSE 't' || event_id END AS platform_id,
        CASE platform
            WHEN 'youtube' THEN CASE WHEN event_id % 4 = 0 THEN 'up' ELSE 'c' END || user_id
            WHEN 'reddit' THEN 'a' || user_id ELSE 'u' || user_id END AS author_handle
    FROM base
    WHERE platform NOT IN ('youtube', 'reddit')
        OR (CAST(ts AS DATE) BETWEEN DATE '{START}' AND DATE '{END}'
            AND (platform = 'reddit'
                OR (event_id % 17 <> 0 AND event_id % 10 NOT IN (0, 1))))""")
def _(lake):
    reddit = F.to_json(F.struct(
        F.concat(F.lit("r"), _text("event_id")).alias("id"), F.col("text").alias("selftext"),
        F.concat(F.lit("a"), _text("user_id")).alias("author"),
        seed.epoch_seconds(F.col("ts")).alias("created_utc"),
    ))
    item = (
        F.when(F.col("platform") == "youtube", _youtube_item())
        .when(F.col("platform") == "reddit", reddit).otherwise(_tweet_item())
    )
    items = write_table(
        _range(lake.base().select("platform", item.alias("item"))), lake.fresh("items"),
        "platform")
    return normalise.route_by_platform(items).select("platform", "platform_id", "author_handle")


@query("assign_lineage_ids", """
    SELECT e.event_id AS id, 'sr-' || e.event_type AS search_request_id,
        'cr-' || e.event_type || '-' || CAST(CAST(e.ts AS DATE) AS VARCHAR) AS crawl_run_id
    FROM events e""")
def _(lake):
    crawled = lake.source("events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("sr-"), "event_type").alias("request_id"),
        F.to_date("ts").alias("crawl_day"), F.lit("temporary").alias("search_request_id"),
        F.lit("temporary").alias("crawl_run_id"),
    )
    return normalise.assign_lineage_ids(crawled, lake.crawl_runs).select(
        "id", "search_request_id", "crawl_run_id"
    )


# --- sinks ---------------------------------------------------------------------------------


@query("publish_view", """
    SELECT search_request_id, keyword, count(*) AS total_posts,
        CAST(sum(like_count) AS BIGINT) AS total_likes, max(ai_version) AS ai_version
    FROM gold_all GROUP BY ALL""")
def _(lake):
    publish_views(
        lake.spark, lake.bronze_posts, lake.search_requests, lake.silver_ai_enrichment,
        lake.silver_posts, prefix="v_",
    )
    return lake.spark.sql(
        "SELECT search_request_id, keyword, total_posts, total_likes, ai_version"
        " FROM v_gold_campaign_summary"
    )


@query("write_gold_partitioned", """
    SELECT search_request_id, platform, date, total_posts, total_likes FROM daily""")
def _(lake):
    path = lake.fresh("daily_by_campaign")
    daily = lake.gold_campaign_daily
    write_gold_partitioned(daily, path)
    one = daily.filter("search_request_id = 'sr-click'")
    return write_gold_partitioned(one, path).select(
        "search_request_id", "platform", "date", "total_posts", "total_likes"
    )


LAYER_COUNTS = """
    SELECT 'search_requests' AS table_name, (SELECT count(*) FROM search_requests) AS rows
    UNION ALL SELECT 'crawl_runs', (SELECT count(*) FROM crawl_runs)
    UNION ALL SELECT 'bronze_posts', (SELECT count(*) FROM bronze_posts)
    UNION ALL SELECT 'silver_posts', (SELECT count(*) FROM silver_posts)
    UNION ALL SELECT 'silver_ai_enrichment', (SELECT count(*) FROM enrichment)
    UNION ALL SELECT 'ai_jobs', (SELECT count(*) FROM ai_jobs)
    UNION ALL SELECT 'gold_post_search', (SELECT count(*) FROM gold)
    UNION ALL SELECT 'gold_campaign_daily', (SELECT count(*) FROM daily)
    UNION ALL SELECT 'gold_campaign_summary', (SELECT count(*) FROM summary)
    UNION ALL SELECT 'gold_build_tracking', (SELECT count(*) FROM tracking)"""
COUNTED = ["search_requests", "crawl_runs", "bronze_posts", "silver_posts",
           "silver_ai_enrichment", "ai_jobs", "gold_post_search", "gold_campaign_daily",
           "gold_campaign_summary", "gold_build_tracking"]


@query("export_layers", LAYER_COUNTS)
def _(lake):
    from chatterlake.operators.serve import table_row_counts

    copies = export_layers(lake.layers(*COUNTED), lake.fresh("export"), "20240201T000000")
    return table_row_counts(copies)


# --- silver columns ------------------------------------------------------------------------


@query("silver_extract", """
    SELECT id, bronze_post_id, search_request_id, platform, platform_id, author_handle,
        author_name, md5(post_text) AS text_md5, posted_at, like_count, share_count, reply_count,
        view_count, post_url, is_retweet, created_at FROM silver_posts""")
def _(lake):
    return S.silver_extract(lake.bronze_posts).withColumn("text_md5", F.md5("post_text")).drop(
        "post_text"
    )


def _bronze(lake):
    return with_payload(lake.bronze_posts)


@query("author_name", "SELECT id, author_name FROM silver_posts")
def _(lake):
    return _bronze(lake).select("id", S.author_name(F.col("p")).alias("author_name"))


@query("post_text", """
    SELECT id, md5(post_text) AS text_md5, length(post_text) AS chars FROM silver_posts""")
def _(lake):
    text = _bronze(lake).select("id", S.post_text(F.col("p")).alias("t"))
    return text.select(
        "id", F.md5("t").alias("text_md5"), F.length("t").cast("bigint").alias("chars")
    )


@query("posted_at", "SELECT id, posted_at FROM silver_posts")
def _(lake):
    return _bronze(lake).select("id", S.posted_at(F.col("p")).alias("posted_at"))


@query("engagement_counts", """
    SELECT id, like_count, share_count, reply_count, view_count FROM silver_posts""")
def _(lake):
    counts = S.engagement_counts(F.col("p"))
    return _bronze(lake).select("id", *[c.alias(n) for n, c in counts.items()])


@query("post_url", "SELECT id, post_url FROM silver_posts")
def _(lake):
    return _bronze(lake).select("id", S.post_url(F.col("p")).alias("post_url"))


@query("is_retweet", "SELECT id, is_retweet FROM silver_posts")
def _(lake):
    return _bronze(lake).select("id", S.is_retweet(F.col("p")).alias("is_retweet"))


@query("reach_estimate", """
    SELECT id, CASE WHEN view_count > 0 THEN view_count
        ELSE (like_count + share_count + reply_count) * 10 END AS reach FROM silver_posts""")
def _(lake):
    counts = [F.col(f"{c}_count") for c in ("like", "share", "reply", "view")]
    return lake.silver_posts.select("id", N.reach_estimate(*counts).alias("reach"))


@query("extract_hashtags", """
    SELECT id, array_to_string(text_hashtags, ',') AS hashtags, len(text_hashtags) AS n
    FROM tagged""")
def _(lake):
    tags = lake.silver_posts.select("id", X.hashtags_in(F.col("post_text")).alias("h"))
    return tags.select(
        "id", F.array_join("h", ",").alias("hashtags"), F.size("h").cast("bigint").alias("n")
    )


@query("extract_mentions", """
    SELECT id, array_to_string(text_mentions, ',') AS mentions, len(text_mentions) AS n
    FROM tagged""")
def _(lake):
    tags = lake.silver_posts.select("id", X.mentions_in(F.col("post_text")).alias("m"))
    return tags.select(
        "id", F.array_join("m", ",").alias("mentions"), F.size("m").cast("bigint").alias("n")
    )


@query("merge_tags", f"""
    SELECT id, array_to_string({merged('own_hashtags', 'text_hashtags')}, ',') AS hashtags,
        array_to_string({merged('own_mentions', 'text_mentions')}, ',') AS mentions
    FROM tagged""")
def _(lake):
    tagged = S.with_tags(S.silver_extract(lake.bronze_posts, keep_extras=True))
    return tagged.select(
        "id", F.array_join("hashtags", ",").alias("hashtags"),
        F.array_join("mentions", ",").alias("mentions"),
    )


@query("platforms_label", """
    SELECT search_request_id, CASE WHEN len(platforms) = 0 THEN 'unknown'
        ELSE array_to_string(platforms, ', ') END AS platforms FROM summary""")
def _(lake):
    return lake.gold_campaign_summary.select(
        "search_request_id", X.platforms_label(F.col("platforms")).alias("platforms")
    )


@query("campaign_label", """
    SELECT DISTINCT search_request_id, keyword || ' (' || platform || ')' AS label FROM gold""")
def _(lake):
    label = X.campaign_label(F.col("keyword"), F.col("platform"))
    return lake.gold_post_search.select("search_request_id", label.alias("label")).distinct()


@query("surrogate_key", """
    SELECT md5(search_request_id || keyword || platform || CAST(date AS VARCHAR)) AS daily_id,
        md5(search_request_id || keyword) AS summary_id FROM daily""")
def _(lake):
    keys = [F.col(c) for c in ("search_request_id", "keyword", "platform", "date")]
    return lake.gold_campaign_daily.select(
        X.surrogate_key(*keys).alias("daily_id"), X.surrogate_key(*keys[:2]).alias("summary_id")
    )


@query("keyword_slug", """
    SELECT doc_id, lower(regexp_replace(text, '[^a-zA-Z0-9]', '', 'g')) AS slug FROM documents""")
def _(lake):
    return lake.source("documents").select(
        "doc_id", X.keyword_slug(F.col("text")).alias("slug")
    )


@query("estimate_tokens", """
    SELECT doc_id, CASE WHEN length(coalesce(text, '')) = 0 THEN 0
        ELSE greatest(1, length(text) // 4) END AS tokens FROM documents""")
def _(lake):
    return lake.source("documents").select(
        "doc_id", X.estimate_tokens(F.col("text")).alias("tokens")
    )


@query("request_dedup_key", """
    SELECT id, keyword || ':' || platform || ':' || start_date || ':' || end_date AS dedup_key
    FROM search_requests""")
def _(lake):
    key = X.request_key(*[F.col(c) for c in ("keyword", "platform", "start_date", "end_date")])
    return lake.search_requests.select("id", key.alias("dedup_key"))


@query("model_version", """
    SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS version FROM pages""")
def _(lake):
    return lake.source("pages").select(
        "page_id", X.model_version(F.col("url")).alias("version")
    )


@query("truncate_text", """
    SELECT doc_id, md5(substr(text, 1, 512)) AS local_md5, md5(substr(text, 1, 2000)) AS remote_md5
    FROM documents""")
def _(lake):
    text = F.col("text")
    return lake.source("documents").select(
        "doc_id", F.md5(X.truncate(text)).alias("local_md5"),
        F.md5(X.truncate(text, X.REMOTE_MODEL_CHARS)).alias("remote_md5"),
    )


@query("status_label", """
    SELECT id, CASE status WHEN 'completed' THEN 'Completed' WHEN 'running' THEN 'Running'
        WHEN 'pending' THEN 'Pending' WHEN 'failed' THEN 'Failed' ELSE 'Unknown' END AS label
    FROM ai_jobs""")
def _(lake):
    return lake.ai_jobs.select("id", X.status_label(F.col("status")).alias("label"))


@query("null_defaults", """
    SELECT s.id, e.id IS NULL AS absent, len(coalesce(e.hashtags, [])) AS hashtag_count,
        len(coalesce(e.mentions, [])) AS mention_count, coalesce(e.ai_version, 1) AS version
    FROM silver_posts s LEFT JOIN enrichment e ON e.silver_post_id = s.id AND e.ai_version = 1""")
def _(lake):
    side = G.enrichment_at(lake.silver_ai_enrichment, 1).withColumnRenamed("id", "en_id")
    rows = lake.silver_posts.select("id").join(
        side, F.col("id") == F.col("silver_post_id"), "left"
    ).select("id", F.col("en_id").isNull().alias("absent"), *G.null_defaults())
    return rows.select(
        "id", "absent", F.size("hashtags").cast("bigint").alias("hashtag_count"),
        F.size("mentions").cast("bigint").alias("mention_count"),
        F.col("ai_version").alias("version"),
    )


assert set(COUNTED) <= {*LAYERS, *VIEWS}
