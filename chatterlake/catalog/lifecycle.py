"""Inserts, merges, state changes, retention and rebuilds."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlake import schemas
from chatterlake.catalog.registry import query
from chatterlake.functions.times import ntz
from chatterlake.operators import gold as G
from chatterlake.operators import lifecycle as L
from chatterlake.operators import silver as S
from chatterlake.operators.serve import union_all

CUT = "2024-01-10 00:00:00"
NOW = "2024-02-01 12:00:00"


@query("dedup_bronze", f"""
    WITH stored AS (SELECT platform, platform_id FROM raw_posts
        WHERE fetched_at < TIMESTAMP '{CUT}')
    SELECT id, platform, platform_id, search_request_id, md5(author_handle) AS author_md5
    FROM raw_posts WHERE fetched_at >= TIMESTAMP '{CUT}'
        AND (platform, platform_id) NOT IN (SELECT (platform, platform_id) FROM stored)
    QUALIFY row_number() OVER (PARTITION BY platform, platform_id ORDER BY fetched_at, id) = 1""")
def _(lake):
    late = F.col("fetched_at") >= ntz(CUT)
    fresh = S.dedup_bronze(lake.raw_posts.filter(late), lake.raw_posts.filter(~late))
    return fresh.select(
        "id", "platform", "platform_id", "search_request_id",
        F.md5("author_handle").alias("author_md5"),
    )


@query("append_new_by_id", f"""
    SELECT 'silver' AS what, CAST(id AS VARCHAR) AS id FROM silver_posts
    WHERE created_at >= TIMESTAMP '{CUT}'
    UNION ALL SELECT 'enrichment', id FROM enrichment WHERE ai_version = 2
    UNION ALL SELECT 'daily', search_request_id || platform || date FROM daily
    WHERE date >= DATE '2024-01-10'
    UNION ALL SELECT 'posts', id || ':' || length(post_text) FROM gold
    WHERE created_at >= TIMESTAMP '{CUT}'""")
def _(lake):
    silver, enrichment, daily = (
        lake.silver_posts.select("id", "created_at"),
        lake.silver_ai_enrichment.select("id", "silver_post_id", "ai_version"),
        lake.gold_campaign_daily.select(*G.DAILY_KEYS),
    )
    posts = lake.gold_refs
    old_silver = silver.filter(F.col("created_at") < ntz(CUT))
    twice = enrichment.unionByName(enrichment)
    key = F.concat(*[F.col(c).cast("string") for c in G.DAILY_KEYS])
    return union_all([
        S.append_new(silver, old_silver, ["id"], ["created_at"])
        .select(F.lit("silver").alias("what"), F.col("id").cast("string").alias("id")),
        S.append_new(twice, enrichment.filter("ai_version = 1"),
                     ["silver_post_id", "ai_version"], ["id"])
        .select(F.lit("enrichment").alias("what"), "id"),
        S.append_new(daily, daily.filter("date < DATE'2024-01-10'"), G.DAILY_KEYS, ["date"])
        .select(F.lit("daily").alias("what"), key.alias("id")),
        lake.with_texts(S.append_new(posts, posts.filter(F.col("created_at") < ntz(CUT)), ["id"], ["created_at"]))
        .select(F.lit("posts").alias("what"),
                F.concat_ws(":", "id", F.length("post_text")).alias("id")),
    ])


def _request_changes(lake):
    """Crawl results per request, plus one request that is not stored yet."""
    crawled = lake.crawl_runs.filter("status = 'completed'").groupBy("search_request_id").agg(
        F.sum("posts_fetched").alias("posts_found"), F.max("completed_at").alias("updated_at"),
    )
    return crawled.select(
        F.regexp_replace("search_request_id", "sr-signup", "sr-new").alias("id"),
        F.lit("changed").alias("keyword"), F.lit("2023-01-01").cast("date").alias("start_date"),
        F.lit("2023-01-02").cast("date").alias("end_date"), F.lit("reddit").alias("platform"),
        F.lit("completed").alias("status"), "posts_found",
        F.lit(None).cast("timestamp_ntz").alias("created_at"), "updated_at",
    )


_CHANGES = """SELECT replace(search_request_id, 'sr-signup', 'sr-new') AS id,
    CAST(sum(posts_fetched) AS BIGINT) AS posts_found, max(completed_at) AS updated_at
    FROM crawl_runs WHERE status = 'completed' GROUP BY 1"""


@query("upsert_requests", f"""
    SELECT coalesce(r.id, c.id) AS id,
        CASE WHEN r.id IS NULL THEN 'changed' ELSE r.keyword END AS keyword,
        CASE WHEN r.id IS NULL THEN DATE '2023-01-01' ELSE r.start_date END AS start_date,
        CASE WHEN r.id IS NULL THEN DATE '2023-01-02' ELSE r.end_date END AS end_date,
        CASE WHEN r.id IS NULL THEN 'reddit' ELSE r.platform END AS platform,
        CASE WHEN c.id IS NOT NULL THEN 'completed' ELSE r.status END AS status,
        CASE WHEN c.id IS NOT NULL THEN c.posts_found ELSE r.posts_found END AS posts_found,
        r.created_at, CASE WHEN c.id IS NOT NULL THEN c.updated_at ELSE r.updated_at END
            AS updated_at
    FROM search_requests r FULL JOIN ({_CHANGES}) c ON c.id = r.id""")
def _(lake):
    return L.upsert_requests(lake.search_requests, _request_changes(lake))


@query("replace_summary", """
    SELECT search_request_id, CASE WHEN search_request_id IN (SELECT search_request_id FROM gold)
        THEN total_posts ELSE total_posts - 1 END AS total_posts FROM summary""")
def _(lake):
    stale = lake.gold_campaign_summary.withColumn("total_posts", F.col("total_posts") - 1)
    fresh = G.summary_keys_to_replace(lake.gold_campaign_summary, lake.gold_post_search)
    return G.replace_by_key(stale, fresh, ["search_request_id"]).select(
        "search_request_id", "total_posts"
    )


@query("replace_daily", f"""
    SELECT search_request_id, platform, date,
        CASE WHEN date >= DATE '2024-01-10' THEN total_posts ELSE 0 END AS total_posts
    FROM daily""")
def _(lake):
    stale = lake.gold_campaign_daily.withColumn("total_posts", F.lit(0).cast("bigint"))
    fresh = lake.gold_campaign_daily.filter("date >= DATE'2024-01-10'")
    return G.replace_by_key(stale, fresh, G.DAILY_KEYS).select(*G.DAILY_KEYS, "total_posts")


@query("delete_campaign_posts", """
    SELECT search_request_id, count(*) AS kept, CAST(sum(like_count) AS BIGINT) AS likes
    FROM gold WHERE search_request_id NOT IN (SELECT id FROM search_requests
        WHERE status = 'pending') GROUP BY 1""")
def _(lake):
    gone = lake.search_requests.filter("status = 'pending'").select(
        F.col("id").alias("search_request_id")
    )
    return G.delete_campaigns(lake.gold_post_search, gone).groupBy("search_request_id").agg(
        F.count(F.lit(1)).alias("kept"), F.sum("like_count").alias("likes")
    )


@query("set_job_status", f"""
    SELECT id, CASE WHEN silver_post_id % 3 = 0 THEN 'running'
            WHEN silver_post_id % 3 = 1 AND status <> 'completed' THEN 'failed' ELSE status END
            AS status,
        CASE WHEN silver_post_id % 3 = 0 THEN NULL
            WHEN silver_post_id % 3 = 1 AND status <> 'completed' THEN 'timeout'
            ELSE error_message END AS error_message,
        CASE WHEN silver_post_id % 3 = 0 THEN TIMESTAMP '{NOW}' ELSE started_at END AS started_at,
        CASE WHEN silver_post_id % 3 = 1 AND status <> 'completed' THEN TIMESTAMP '{NOW}'
            ELSE completed_at END AS completed_at
    FROM ai_jobs""")
def _(lake):
    kind = F.col("silver_post_id") % 3
    changes = lake.ai_jobs.filter((kind == 0) | ((kind == 1) & (F.col("status") != "completed")))
    changes = changes.select(
        "id", F.when(kind == 0, F.lit("running")).otherwise(F.lit("failed")).alias("status"),
        F.when(kind == 1, F.lit("timeout")).alias("error_message"), ntz(NOW).alias("at"),
    )
    return L.set_job_status(lake.ai_jobs, changes).select(
        "id", "status", "error_message", "started_at", "completed_at"
    )


@query("set_run_status", f"""
    SELECT id, CASE WHEN status = 'failed' THEN 'running' ELSE 'completed' END AS status,
        CASE WHEN status = 'failed' THEN 0 ELSE posts_fetched END AS posts_fetched,
        CAST(NULL AS VARCHAR) AS error_message,
        CASE WHEN status = 'failed' THEN completed_at ELSE TIMESTAMP '{NOW}' END AS completed_at
    FROM crawl_runs""")
def _(lake):
    failed = F.col("status") == "failed"
    changes = lake.crawl_runs.select(
        "id", F.when(failed, F.lit("running")).otherwise(F.lit("completed")).alias("status"),
        F.when(failed, F.lit(0).cast("bigint")).otherwise(F.col("posts_fetched"))
        .alias("posts_fetched"),
        F.lit(None).cast("string").alias("error_message"), ntz(NOW).alias("at"),
    )
    return L.set_run_status(lake.crawl_runs, changes).select(
        "id", "status", "posts_fetched", "error_message", "completed_at"
    )


@query("set_request_status", f"""
    SELECT r.id, CASE WHEN c.n IS NULL THEN r.status ELSE 'running' END AS status,
        coalesce(c.n, r.posts_found) AS posts_found,
        CASE WHEN c.n IS NULL THEN r.updated_at ELSE TIMESTAMP '{NOW}' END AS updated_at
    FROM search_requests r LEFT JOIN (SELECT search_request_id AS id, count(*) AS n
        FROM bronze_posts GROUP BY 1) c ON c.id = r.id""")
def _(lake):
    changes = lake.bronze_posts.groupBy(F.col("search_request_id").alias("id")).agg(
        F.count(F.lit(1)).alias("posts_found")
    ).select("id", F.lit("running").alias("status"), "posts_found", ntz(NOW).alias("at"))
    return L.set_request_status(lake.search_requests, changes).select(
        "id", "status", "posts_found", "updated_at"
    )


@query("set_attempts", """
    SELECT id, CASE WHEN status = 'failed' THEN attempts + 1 ELSE attempts END AS attempts
    FROM ai_jobs""")
def _(lake):
    changes = lake.ai_jobs.filter("status = 'failed'").select(
        "id", (F.col("attempts") + 1).alias("attempts")
    )
    return L.set_attempts(lake.ai_jobs, changes).select("id", "attempts")


@query("reset_failed_jobs", """
    SELECT id, CASE WHEN status = 'failed' THEN 'pending' ELSE status END AS status,
        CASE WHEN status <> 'failed' THEN error_message END AS error_message,
        CASE WHEN status <> 'failed' THEN started_at END AS started_at,
        CASE WHEN status <> 'failed' THEN completed_at END AS completed_at FROM ai_jobs""")
def _(lake):
    return L.reset_failed_jobs(lake.ai_jobs, "full_enrichment").select(
        "id", "status", "error_message", "started_at", "completed_at"
    )


_PURGED = {"gold_campaign_daily": "created_at", "gold_campaign_summary": "created_at", "ai_jobs": "created_at", "silver_posts": "created_at", "bronze_posts": "fetched_at",
           "crawl_runs": "started_at", "search_requests": "created_at",
           "gold_post_search": "created_at", "silver_ai_enrichment": "created_at",
           "gold_build_tracking": "last_built_at"}
_SQL_NAMES = {"gold_campaign_daily": "daily", "gold_campaign_summary": "summary",
              "gold_post_search": "gold", "silver_ai_enrichment": "enrichment",
              "gold_build_tracking": "tracking"}


@query("purge_expired", " UNION ALL ".join(f"""
    SELECT '{t}' AS table_name, count(*) FILTER ({c} < TIMESTAMP '2024-01-15') AS purged,
        count(*) FILTER ({c} >= TIMESTAMP '2024-01-15') AS kept FROM {_SQL_NAMES.get(t, t)}"""
    for t, c in _PURGED.items()))
def _(lake):
    cutoff = L.retention_cutoff("2024-04-14 00:00:00")
    tables = lake.layers(*_PURGED)
    kept = {
        t: df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(t).alias("table_name"), "kept")
        for t, df in L.purge_expired(tables, cutoff).items()
    }
    counted = L.purge_counts(tables, cutoff).drop("kept")
    return counted.join(union_all(list(kept.values())), "table_name")


@query("record_build", f"""
    SELECT 'sr-' || event_type AS search_request_id, TIMESTAMP '{NOW}' AS last_built_at,
        count(*) AS posts_processed FROM events WHERE event_type <> 'view' GROUP BY event_type
    UNION ALL SELECT * FROM tracking WHERE search_request_id = 'sr-view'""")
def _(lake):
    built = lake.raw_posts.filter("search_request_id <> 'sr-view'").groupBy(
        "search_request_id").agg(F.count(F.lit(1)).alias("posts_processed"))
    return G.record_build(lake.gold_build_tracking, built, ntz(NOW))


@query("stamp_lineage", f"""
    SELECT d.what, d.key, r.run AS source_crawl_run_id,
        j.job AS enrichment_job_id, TIMESTAMP '{NOW}' AS lineage_updated_at
    FROM (SELECT 'daily' AS what, search_request_id, platform || date AS key FROM daily
        UNION ALL SELECT 'summary', search_request_id, search_request_id FROM summary
        UNION ALL SELECT 'posts', search_request_id, CAST(id AS VARCHAR) FROM gold) d
    LEFT JOIN (SELECT search_request_id, max_by(id, (completed_at, id)) AS run FROM crawl_runs
        WHERE status = 'completed' GROUP BY 1) r USING (search_request_id)
    LEFT JOIN (SELECT s.search_request_id, max_by(j.id, (j.completed_at, j.id)) AS job
        FROM ai_jobs j JOIN silver_posts s ON s.id = j.silver_post_id
        WHERE j.status = 'completed' GROUP BY 1) j USING (search_request_id)""")
def _(lake):
    keys = [
        ("daily", lake.gold_campaign_daily, F.concat("platform", F.col("date").cast("string"))),
        ("summary", lake.gold_campaign_summary, F.col("search_request_id")),
        ("posts", lake.gold_post_search, F.col("id").cast("string")),
    ]
    return union_all([
        df.select(F.lit(what).alias("what"), key.alias("key"), "source_crawl_run_id",
                  "enrichment_job_id", "lineage_updated_at") for what, df, key in keys
    ])


@query("evolve_schema", """
    SELECT id, search_request_id, CAST(NULL AS DOUBLE) AS topic_confidence,
        CAST(NULL AS VARCHAR) AS source_crawl_run_id FROM gold""")
def _(lake):
    oldest = schemas.evolve_schema(lake.gold_post_search, "gold_post_search", 1)
    newest = schemas.evolve_schema(oldest, "gold_post_search")
    return newest.select("id", "search_request_id", "topic_confidence", "source_crawl_run_id")


@query("touched_campaigns", """
    SELECT DISTINCT search_request_id FROM silver_posts WHERE search_request_id <> 'sr-click'""")
def _(lake):
    return G.touched_campaigns(lake.silver_posts, _tracking(lake))


def _tracking(lake):
    """Build times where one campaign has had no new post since its build."""
    return lake.gold_build_tracking.withColumn(
        "last_built_at",
        F.when(F.col("search_request_id") == "sr-click", ntz(NOW))
        .otherwise(F.col("last_built_at")),
    )


@query("incremental_gold", """
    SELECT id, search_request_id, md5(post_text) AS text_md5, sentiment, like_count FROM gold
    WHERE search_request_id <> 'sr-click'""")
def _(lake):
    return lake.with_texts(G.incremental_gold(
        lake.silver_refs, lake.silver_ai_enrichment, lake.search_requests, _tracking(lake)
    )).select("id", "search_request_id", F.md5("post_text").alias("text_md5"), "sentiment",
             "like_count")
