"""Filters, work lists, validation and table checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlake.catalog.registry import query, strip
from chatterlake.functions.times import day, duration_days, in_closed_range
from chatterlake.operators import quality as Q
from chatterlake.operators import search_index
from chatterlake.operators import serve as V
from chatterlake.schemas import SENTIMENTS

PAGE = "posted_at DESC NULLS LAST, id"


@query("filter_posts", f"""
    SELECT id, sentiment, platform, language, posted_at FROM gold
    WHERE keyword = 'click' AND sentiment = 'positive' AND platform = 'twitter'
        AND language = 'en' AND posted_at >= TIMESTAMP '2024-01-03'
        AND posted_at < TIMESTAMP '2024-01-28'
    ORDER BY {PAGE} LIMIT 50 OFFSET 10""")
def _(lake):
    hits = V.filter_posts(
        lake.gold_post_search, "click", "positive", "twitter", "en", "2024-01-03", "2024-01-28",
        limit=50, offset=10, requests=lake.search_requests,
    )
    return hits.select("id", "sentiment", "platform", "language", "posted_at")


@query("search_posts", f"""
    WITH hits AS (SELECT * FROM gold WHERE post_text ILIKE '%TION%'
        AND posted_at BETWEEN TIMESTAMP '2024-01-02' AND TIMESTAMP '2024-01-29')
    SELECT id, md5(post_text) AS text_md5, posted_at, (SELECT count(*) FROM hits) AS total
    FROM hits ORDER BY {PAGE} LIMIT 50 OFFSET 50""")
def _(lake):
    page = V.search_posts(
        lake.gold_refs, 50, 50, lake.fresh("search"), read=lake.with_texts, read_page=lake.with_texts_of, keyword="TION",
        start="2024-01-02", end="2024-01-29",
    )
    return V.with_total(page).select(
        "id", F.md5("post_text").alias("text_md5"), "posted_at", "total"
    )


_indexes: dict[tuple[str, str], object] = {}


def text_index(lake):
    """Trigram index over the gold posts, built once per application."""
    key = (lake.spark.sparkContext.applicationId, lake.source_dir)
    if key not in _indexes:
        _indexes[key] = search_index.add_files(lake.stored("gold_post_search"), lake.fresh("text-index"))
    return _indexes[key]


@query("search_indexed", """
    WITH hits AS (SELECT * FROM gold WHERE post_text ILIKE '%e%n_tion%')
    SELECT id, md5(post_text) AS text_md5, posted_at, (SELECT count(*) FROM hits) AS total FROM hits""")
def _(lake):
    page = V.search_posts(
        lake.stored("gold_post_search"), work=lake.fresh("search"), keyword="E%n_TION", index=text_index(lake))
    return V.with_total(page).select("id", F.md5("post_text").alias("text_md5"), "posted_at", "total")


@query("search_index_files", """
    SELECT count(*) > 0 AS found FROM gold WHERE post_text ILIKE '%zqxj kwv%'""")
def _(lake):
    """A text that no post has is settled by the index: no file is left to read."""
    return V.matching_posts(lake.stored("gold_post_search"), "zqxj kwv", index=text_index(lake)).agg(
        (F.count(F.lit(1)) > 0).alias("found"))


def _incoming(lake):
    """Raw posts with some ids blank and some payloads NULL or empty."""
    return lake.raw_posts.select(
        "id", F.when(F.col("id") % 29 != 0, F.col("platform_id")).otherwise(F.lit(""))
        .alias("platform_id"),
        F.when(F.col("id") % 31 == 0, F.lit("{}")).when(F.col("id") % 37 != 0, F.col("raw_payload"))
        .alias("raw_payload"),
    )


_ERRORS = """CASE WHEN id % 29 = 0 AND (id % 31 = 0 OR id % 37 = 0)
        THEN 'platform_id is required; raw_payload must be a non-empty dict'
    WHEN id % 29 = 0 THEN 'platform_id is required'
    WHEN id % 31 = 0 OR id % 37 = 0 THEN 'raw_payload must be a non-empty dict' END"""


@query("validate_raw_posts", f"SELECT id, {_ERRORS} AS errors FROM raw_posts")
def _(lake):
    return Q.validate_raw_posts(_incoming(lake)).select("id", "errors")


@query("validation_summary", f"""
    SELECT count(*) AS total, count(*) FILTER ({_ERRORS} IS NULL) AS valid,
        count(*) FILTER ({_ERRORS} IS NOT NULL) AS skipped FROM raw_posts""")
def _(lake):
    return Q.validation_summary(Q.validate_raw_posts(_incoming(lake)))


@query("validate_requests", f"""
    SELECT doc_id, nullif(array_to_string(list_filter([
        CASE WHEN {strip("keyword")} = '' THEN 'keyword must not be empty' END,
        CASE WHEN length(keyword) > 200 THEN 'keyword must be at most 200 characters' END,
        CASE WHEN doc_id % 5 = 4 THEN 'platform is not supported' END,
        CASE WHEN doc_id % 11 = 0 THEN 'start_date must be YYYY-MM-DD' END,
        CASE WHEN doc_id % 11 <> 0 AND end_day < start_day
            THEN 'end_date must be on or after start_date' END,
        CASE WHEN doc_id % 11 <> 0 AND end_day - start_day > 365
            THEN 'date range must be 365 days or less' END],
        lambda m: m IS NOT NULL), '; '), '') AS errors
    FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '  ' ELSE text END AS keyword,
            DATE '2024-01-01' AS start_day,
            DATE '2023-12-01' + CAST(doc_id % 700 AS INTEGER) AS end_day FROM documents)""")
def _(lake):
    d = F.col("doc_id")
    end = F.date_add(day("2023-12-01"), (d % 700).cast("int"))
    requests = lake.source("documents").select(
        "doc_id", F.when(d % 3 == 0, F.lit("  ")).otherwise(F.col("text")).alias("keyword"),
        F.when(d % 5 == 4, F.lit("myspace")).otherwise(F.lit("reddit")).alias("platform"),
        F.when(d % 11 == 0, F.lit("2024-1-1")).otherwise(F.lit("2024-01-01")).alias("start_date"),
        end.cast("string").alias("end_date"),
    )
    return Q.validate_requests(requests).select("doc_id", "errors")


@query("date_range_contains", """
    SELECT s.id, CAST(s.posted_at AS DATE) BETWEEN r.start_date AND r.end_date AS inside,
        r.end_date - r.start_date AS duration_days
    FROM silver_posts s JOIN search_requests r ON r.id = s.search_request_id""")
def _(lake):
    requests = lake.search_requests.select(
        F.col("id").alias("search_request_id"), "start_date", "end_date"
    )
    start, end = F.col("start_date"), F.col("end_date")
    return lake.silver_posts.join(requests, "search_request_id").select(
        "id", in_closed_range(F.to_date("posted_at"), start, end).alias("inside"),
        duration_days(start, end).cast("bigint").alias("duration_days"),
    )


_NULL_CHECKS = {
    "bronze_posts": ["id", "search_request_id", "platform", "platform_id", "author_handle"],
    "silver_posts": ["id", "author_name", "post_text", "posted_at", "post_url"],
    "gold_post_search": ["id", "keyword", "sentiment", "topic_label"],
}
_SQL_NAMES = {"gold_post_search": "gold"}


@query("check_not_null", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) - count({c}) AS failures "
    f"FROM {_SQL_NAMES.get(t, t)}" for t, cs in _NULL_CHECKS.items() for c in cs))
def _(lake):
    return V.union_all([Q.check_not_null(lake.layer(t), t, cs) for t, cs in _NULL_CHECKS.items()])


_UNIQUE_CHECKS = [("bronze_posts", ["id"]), ("bronze_posts", ["platform", "platform_id"]),
                  ("raw_posts", ["platform", "platform_id"]), ("gold_post_search", ["id"]),
                  ("gold_post_search", ["author_handle"])]


@query("check_unique", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{', '.join(k)}' AS column_name, count(*) AS failures FROM ("
    f"SELECT 1 FROM {_SQL_NAMES.get(t, t)} WHERE {' AND '.join(f'{c} IS NOT NULL' for c in k)} "
    f"GROUP BY {', '.join(k)} HAVING count(*) > 1)" for t, k in _UNIQUE_CHECKS))
def _(lake):
    return V.union_all([Q.check_unique(lake.layer(t), t, k) for t, k in _UNIQUE_CHECKS])


@query("check_relationship", """
    SELECT 'crawl_runs' AS table_name, 'search_request_id' AS column_name,
        count(*) FILTER (search_request_id NOT IN (SELECT id FROM search_requests)) AS failures
    FROM crawl_runs
    UNION ALL SELECT 'bronze_posts', 'search_request_id',
        count(*) FILTER (search_request_id NOT IN (SELECT id FROM search_requests
            WHERE status = 'completed')) FROM bronze_posts
    UNION ALL SELECT 'bronze_posts', 'crawl_run_id',
        count(*) FILTER (crawl_run_id NOT IN (SELECT id FROM crawl_runs
            WHERE status = 'completed')) FROM bronze_posts""")
def _(lake):
    requests, runs = lake.search_requests, lake.crawl_runs
    done = "status = 'completed'"
    return V.union_all([
        Q.check_relationship(runs, "search_request_id", requests, "id", "crawl_runs"),
        Q.check_relationship(lake.bronze_posts, "search_request_id", requests.filter(done), "id",
                             "bronze_posts"),
        Q.check_relationship(lake.bronze_posts, "crawl_run_id", runs.filter(done), "id",
                             "bronze_posts"),
    ])


@query("check_domain", """
    SELECT 'enrichment' AS table_name, 'sentiment' AS column_name,
        count(*) FILTER (sentiment NOT IN ('positive', 'neutral')) AS failures FROM enrichment
    UNION ALL SELECT 'enrichment', 'sentiment_confidence',
        count(*) FILTER (NOT sentiment_confidence BETWEEN 0 AND 0.9) FROM enrichment
    UNION ALL SELECT 'enrichment', 'topic_confidence',
        count(*) FILTER (NOT topic_confidence BETWEEN 0 AND 1) FROM enrichment""")
def _(lake):
    return Q.check_domain(
        lake.silver_ai_enrichment, "enrichment", {"sentiment": [SENTIMENTS[0], SENTIMENTS[2]]},
        {"sentiment_confidence": (0.0, 0.9), "topic_confidence": (0.0, 1.0)},
    )


@query("lookup_by_key", """
    SELECT 'request' AS what, id AS found FROM search_requests WHERE id = 'sr-view'
    UNION ALL SELECT 'keyword', id FROM search_requests WHERE keyword = 'signup'
    UNION ALL SELECT 'runs', id FROM crawl_runs WHERE search_request_id = 'sr-error'
    UNION ALL SELECT 'post', platform_id FROM silver_posts WHERE bronze_post_id = 123
    UNION ALL SELECT 'enrichment', id FROM enrichment WHERE silver_post_id = 4 AND ai_version = 2
    UNION ALL SELECT 'summary', keyword FROM summary WHERE search_request_id = 'sr-purchase'""")
def _(lake):
    found = [
        ("request", V.lookup(lake.search_requests, id="sr-view"), "id"),
        ("keyword", V.lookup(lake.search_requests, keyword="signup"), "id"),
        ("runs", V.lookup(lake.crawl_runs, search_request_id="sr-error"), "id"),
        ("post", V.lookup(lake.silver_posts, bronze_post_id=123), "platform_id"),
        ("enrichment", V.lookup(lake.silver_ai_enrichment, silver_post_id=4, ai_version=2), "id"),
        ("summary", V.lookup(lake.gold_campaign_summary, search_request_id="sr-purchase"),
         "keyword"),
    ]
    return V.union_all([
        df.select(F.lit(what).alias("what"), F.col(c).alias("found")) for what, df, c in found
    ])


@query("lookup_keyed", """
    SELECT 'silver' AS what, platform_id AS found FROM silver_posts WHERE id = 123
    UNION ALL SELECT 'enrichment', id FROM enrichment WHERE silver_post_id = 4 AND ai_version = 2
    UNION ALL SELECT 'gold', platform FROM gold WHERE id = 77""")
def _(lake):
    """Look-ups by id that open one bucket of the layer."""
    found = [
        ("silver", V.lookup(lake.keyed("silver_refs", "id"), id=123), "platform_id"),
        ("enrichment", V.lookup(lake.keyed("silver_ai_enrichment", "silver_post_id"), silver_post_id=4, ai_version=2), "id"),
        ("gold", V.lookup(lake.keyed("gold_refs", "id"), id=77), "platform"),
    ]
    return V.union_all([
        df.select(F.lit(what).alias("what"), F.col(c).alias("found")) for what, df, c in found
    ])


@query("pending_requests", """
    SELECT id, keyword, created_at FROM search_requests WHERE status = 'pending'
    ORDER BY created_at, id LIMIT 50""")
def _(lake):
    return V.oldest_in_state(lake.search_requests, "pending", 50).select(
        "id", "keyword", "created_at"
    )


@query("completed_requests", """
    SELECT id, keyword, start_date, end_date FROM search_requests WHERE status = 'completed'
    ORDER BY created_at, id""")
def _(lake):
    return V.oldest_in_state(lake.search_requests, "completed", None).select(
        "id", "keyword", "start_date", "end_date"
    )


@query("pending_jobs", """
    SELECT id, silver_post_id, created_at FROM ai_jobs
    WHERE status = 'pending' AND job_type = 'full_enrichment'
    ORDER BY created_at, id LIMIT 100""")
def _(lake):
    return V.oldest_in_state(lake.ai_jobs, "pending", 100, job_type="full_enrichment").select(
        "id", "silver_post_id", "created_at"
    )


@query("posts_since", """
    SELECT id, search_request_id, created_at FROM silver_posts
    WHERE created_at > TIMESTAMP '2024-01-20'""")
def _(lake):
    return V.posts_since(lake.silver_posts, "2024-01-20").select(
        "id", "search_request_id", "created_at"
    )


@query("posts_of", """
    SELECT 'request' AS owner, id, fetched_at FROM bronze_posts
    WHERE search_request_id = 'sr-view'
    UNION ALL SELECT 'run', id, fetched_at FROM bronze_posts
    WHERE crawl_run_id = 'cr-click-2024-01-05'""")
def _(lake):
    parts = [("request", {"search_request_id": "sr-view"}),
             ("run", {"search_request_id": "sr-click", "crawl_run_id": "cr-click-2024-01-05"})]
    return V.union_all([
        V.lookup(lake.bronze_posts, **key)
        .select(F.lit(owner).alias("owner"), "id", "fetched_at") for owner, key in parts
    ])


