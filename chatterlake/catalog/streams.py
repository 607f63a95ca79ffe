"""Structured Streaming queries over the layers, run to the end of what is there.

The layer files are not in time order, so the queries here use a watermark delay longer than
the data; a live stream keeps the defaults of :mod:`chatterlake.streaming.streams`.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chatterlake.catalog.aggregates import LISTS, USAGE, joined_lists
from chatterlake.catalog.registry import MEASURES, query
from chatterlake.functions.times import ntz
from chatterlake.operators import budget as B
from chatterlake.plans.lake import BUILT_AT
from chatterlake.storage import write_table
from chatterlake.streaming import streams as J
from chatterlake.streaming.gold_store import GoldStore, gold_sink

WHOLE_RANGE = "60 days"
WHOLE_SECONDS = 60 * 86_400
ADMIT_LIMIT, ADMIT_HOURS = 3, 6


def _stream(lake, name: str, files: int = 1000):
    table = lake.stored(name)
    return J.read_stream(lake.spark, table, lake.folder(name), files)


def _run(stream, checkpoint: str, sink, mode: str = "append") -> None:
    J.start(stream, checkpoint, sink, mode).awaitTermination()


@query("stream_silver", """
    SELECT id, platform, author_name, md5(post_text) AS text_md5, posted_at, like_count,
        view_count, is_retweet FROM silver_posts""")
def _(lake):
    out = lake.fresh("stream_silver")
    _run(J.silver_stream(_stream(lake, "bronze_posts", 4)), f"{out}/checkpoint", f"{out}/rows")
    rows = lake.spark.read.schema(lake.silver_posts.schema).parquet(f"{out}/rows")
    return rows.select(
        "id", "platform", "author_name", F.md5("post_text").alias("text_md5"), "posted_at",
        "like_count", "view_count", "is_retweet",
    )


@query("stream_requests", """
    SELECT id, keyword, created_at FROM search_requests WHERE status = 'pending'""")
def _(lake):
    out = lake.fresh("stream_requests")
    requests = J.pending_requests_stream(_stream(lake, "search_requests"))
    _run(requests, f"{out}/checkpoint", J.batch_folder(f"{out}/rows"))
    return lake.spark.read.parquet(f"{out}/rows").select("id", "keyword", "created_at")


_KEY = "event_type || ':' || user_id % 5"


def _starts(lake):
    """Start requests: one per event, for a keyword and one of five platforms."""
    platform = (F.col("user_id") % 5).cast("string")
    return lake.source("events").select(
        F.col("event_id").alias("id"), "ts",
        F.concat_ws(":", "event_type", platform).alias("dedup_key"),
    )


REPEATS = f"""
    WITH RECURSIVE s AS (SELECT event_id AS id, {_KEY} AS k, ts, row_number() OVER (
            PARTITION BY {_KEY} ORDER BY ts, event_id) AS rn FROM events),
    r AS (SELECT id, k, ts AS kept, rn, true AS admitted FROM s WHERE rn = 1
        UNION ALL SELECT s.id, s.k,
            CASE WHEN s.ts >= r.kept + INTERVAL 300 SECOND THEN s.ts ELSE r.kept END, s.rn,
            s.ts >= r.kept + INTERVAL 300 SECOND
        FROM r JOIN s ON s.k = r.k AND s.rn = r.rn + 1)
    SELECT id, admitted FROM r"""


@query("dedup_ttl", REPEATS)
def _(lake):
    return B.admit_sliding(_starts(lake), "dedup_key", "ts", "id", 1, B.REPEAT_SECONDS).select(
        "id", "admitted"
    )


def _timed_stream(lake, calls, name: str, time: str = "ts"):
    """A stream over some files of ``calls``, then one of a call far later, after which the watermark
    has passed all others."""
    out = lake.fresh(name)
    table = write_table(calls, f"{out}/calls")
    last = calls.limit(1).withColumn("id", F.lit(-1).cast("bigint")).withColumn(
        time, F.expr("TIMESTAMP_NTZ'2100-01-01'"))
    last.write.mode("append").parquet(f"{out}/calls")
    return out, J.read_stream(lake.spark, table, f"{out}/calls", 3)


def _closed(lake, out: str, rows):
    """What an append query gives out, each row once."""
    _run(rows, f"{out}/checkpoint", f"{out}/rows")
    return lake.spark.read.schema(rows.schema).parquet(f"{out}/rows")


def _decisions(lake, out: str, decided):
    _run(decided.select("id", "admitted"), f"{out}/checkpoint", f"{out}/rows")
    return lake.spark.read.schema("id bigint, admitted boolean").parquet(f"{out}/rows").filter("id >= 0")


@query("stream_dedup", "SELECT id, platform, platform_id FROM bronze_posts")
def _(lake):
    """Ids of the first arrivals, as the batch operator keeps them."""
    calls = lake.raw_posts.select("id", "platform", "platform_id", F.col("fetched_at").alias("ts"))
    out, posts = _timed_stream(lake, calls, "stream_dedup")
    first = J.first_arrivals_stream(posts, ["platform", "platform_id"], WHOLE_RANGE, WHOLE_RANGE)
    return _closed(lake, out, first).filter("id >= 0").select("id", "platform", "platform_id")


@query("stream_dedup_ttl", REPEATS)
def _(lake):
    out, starts = _timed_stream(lake, _starts(lake), "stream_ttl")
    return _decisions(lake, out, J.repeat_requests_stream(starts, B.REPEAT_SECONDS, WHOLE_RANGE))


_DAY_KEYS = ["search_request_id", "platform", "date"]


@query("stream_daily", f"""
    SELECT search_request_id, platform, date, {MEASURES} FROM dated
    GROUP BY search_request_id, platform, date""")
def _(lake):
    out = lake.fresh("stream_daily")
    daily = J.daily_stream(_stream(lake, "gold_refs", 4), WHOLE_RANGE)
    _run(daily, f"{out}/checkpoint", J.batch_folder(f"{out}/rows"), "update")
    changes = lake.spark.read.parquet(f"{out}/rows")
    return J.latest_state(changes, _DAY_KEYS)


@query("stream_daily_tags", """
    SELECT search_request_id, platform, date, item, count(*) AS count FROM (
        SELECT search_request_id, platform, date, unnest(hashtags) AS item FROM dated)
    WHERE item <> '' GROUP BY ALL""")
def _(lake):
    out = lake.fresh("stream_tags")
    tags = J.daily_tags_stream(_stream(lake, "gold_refs", 4), "hashtag", WHOLE_RANGE)
    _run(tags, f"{out}/checkpoint", J.batch_folder(f"{out}/rows"), "update")
    return J.latest_state(lake.spark.read.parquet(f"{out}/rows"), [*_DAY_KEYS, "item"])


@query("stream_daily_table", f"SELECT * EXCLUDE (top_hashtags, top_topics, created_at), {LISTS} FROM daily")
def _(lake):
    """The daily table with its top lists, each day given out once when it is closed."""
    posts = lake.gold_post_search.select(
        "id", "search_request_id", "keyword", "platform", "posted_at", "sentiment", "sentiment_confidence",
        "topic_label", "hashtags", "like_count", "share_count", "reply_count", "view_count", "ai_version")
    out, stream = _timed_stream(lake, posts, "stream_daily_table", "posted_at")
    return joined_lists(_closed(lake, out, J.daily_table_stream(stream, WHOLE_RANGE)), "top_hashtags", "top_topics")


@query("stream_token_usage", f"""
    SELECT *, hour_tokens > 10000 AS over_hourly, day_tokens > 150000 AS over_daily
    FROM ({USAGE})""")
def _(lake):
    out, events = _timed_stream(lake, lake.token_events, "stream_tokens")
    return B.budget_state(_closed(lake, out, J.token_stream(events, WHOLE_RANGE)), hourly=10_000, daily=150_000)


_stores: dict[tuple[str, str], GoldStore] = {}


def _gold_store(lake) -> GoldStore:
    """Gold tables merged batch by batch from the silver stream, in which a tenth of the posts arrives
    twice. The stream runs once per application; its three tables are read from what it wrote."""
    key = (lake.spark.sparkContext.applicationId, lake.source_dir)
    if key not in _stores:
        _stores[key] = _merged_stream(lake)
    return _stores[key]


def _merged_stream(lake) -> GoldStore:
    out = lake.fresh("stream_gold")
    store = GoldStore(lake.spark, f"{out}/gold", lake.search_requests, ntz(BUILT_AT))
    table = write_table(lake.silver_refs, f"{out}/silver")
    lake.silver_refs.filter("id % 10 = 0").write.mode("append").parquet(f"{out}/silver")
    silver = J.read_stream(lake.spark, table, f"{out}/silver", 4)
    _run(silver, f"{out}/checkpoint", gold_sink(store, lambda: lake.silver_ai_enrichment))
    store.vacuum()
    return store


@query("foreach_batch_gold", """
    SELECT id, search_request_id, md5(post_text) AS text_md5, sentiment, like_count FROM gold""")
def _(lake):
    return lake.with_texts(_gold_store(lake).posts()).select(
        "id", "search_request_id", F.md5("post_text").alias("text_md5"), "sentiment", "like_count"
    )


@query("foreach_batch_daily", f"SELECT * EXCLUDE (top_hashtags, top_topics), {LISTS} FROM daily")
def _(lake):
    return joined_lists(_gold_store(lake).daily(), "top_hashtags", "top_topics")


@query("foreach_batch_summary", f"""
    SELECT * EXCLUDE (top_hashtags, top_topics, platforms), {LISTS},
        array_to_string(platforms, ',') AS platforms FROM summary
    WHERE total_posts > 0""")
def _(lake):
    """Campaigns without a post have no row: no batch has touched them."""
    return joined_lists(_gold_store(lake).summary(), "top_hashtags", "top_topics", "platforms")


def _lifecycle(lake):
    """Stream over bronze with some unreadable payloads."""
    out = lake.fresh("stream_jobs")
    broken = lake.bronze_posts.withColumn(
        "raw_payload", F.when(F.col("id") % 97 == 0, F.lit("{")).otherwise(F.col("raw_payload"))
    )
    table = write_table(broken, f"{out}/bronze")
    sink = J.lifecycle_sink(f"{out}/silver", f"{out}/jobs", f"{out}/rejected")
    _run(J.read_stream(lake.spark, table, f"{out}/bronze", 4), f"{out}/checkpoint", sink)
    return out


@query("job_lifecycle", """
    SELECT 'job-' || id AS id, id AS silver_post_id,
        CASE WHEN id % 97 = 0 THEN 'failed' ELSE 'completed' END AS status, 1 AS attempts,
        CASE WHEN id % 97 = 0 THEN 'payload is not valid JSON' END AS error_message
    FROM bronze_posts""")
def _(lake):
    return lake.spark.read.parquet(f"{_lifecycle(lake)}/jobs").drop("batch_id")


@query("job_rejected", """
    SELECT id, platform_id, 'payload is not valid JSON' AS payload_error FROM bronze_posts
    WHERE id % 97 = 0""")
def _(lake):
    return lake.spark.read.parquet(f"{_lifecycle(lake)}/rejected").select(
        "id", "platform_id", "payload_error"
    )


@query("job_retries", """
    SELECT 'job-' || id AS id, id AS silver_post_id,
        CASE WHEN id % 97 = 0 AND id % 2 = 0 THEN 'failed' ELSE 'completed' END AS status,
        CASE WHEN id % 97 <> 0 THEN 1 WHEN id % 2 = 1 THEN 2 ELSE 3 END AS attempts,
        CASE WHEN id % 97 = 0 AND id % 2 = 0 THEN 'payload is not valid JSON' END AS error_message,
        id % 97 = 0 AND id % 2 = 0 AS dead
    FROM bronze_posts""")
def _(lake):
    """Some unreadable payloads arrive again: odd ids are mended at the second try, even ones never."""
    out = lake.fresh("stream_retries")
    first = lake.bronze_posts.withColumn(
        "raw_payload", F.when(F.col("id") % 97 == 0, F.lit("{")).otherwise(F.col("raw_payload")))
    table = write_table(first, f"{out}/bronze")
    again = lake.bronze_posts.filter("id % 97 = 0").withColumn(
        "raw_payload", F.when(F.col("id") % 2 == 0, F.lit("{")).otherwise(F.col("raw_payload")))
    sink = J.lifecycle_sink(f"{out}/silver", f"{out}/jobs", f"{out}/rejected")
    for _ in range(4):  # each time the stream goes on where it was
        _run(J.read_stream(lake.spark, table, f"{out}/bronze"), f"{out}/checkpoint", sink)
        again.write.mode("append").parquet(f"{out}/bronze")
    return J.job_states(lake.spark.read.parquet(f"{out}/jobs"))


ADMITTED = f"""
    WITH RECURSIVE s AS (SELECT event_id AS id, user_id AS k, ts, row_number() OVER (
            PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
    r AS (SELECT id, k, [ts] AS recent, rn, true AS admitted FROM s WHERE rn = 1
        UNION ALL SELECT id, k, CASE WHEN len(kept) < {ADMIT_LIMIT} THEN list_append(kept, ts)
                ELSE kept END, rn, len(kept) < {ADMIT_LIMIT}
        FROM (SELECT s.*, list_filter(r.recent,
                lambda t: t > s.ts - INTERVAL {ADMIT_HOURS} HOUR) AS kept
            FROM r JOIN s ON s.k = r.k AND s.rn = r.rn + 1))
    SELECT id, admitted FROM r"""


def _calls(lake):
    return lake.source("events").select(F.col("event_id").alias("id"), "user_id", "ts")


@query("admit_sliding", ADMITTED)
def _(lake):
    return B.admit_sliding(
        _calls(lake), "user_id", "ts", "id", ADMIT_LIMIT, ADMIT_HOURS * 3600
    ).select("id", "admitted")


@query("admit_stream", ADMITTED)
def _(lake):
    out, calls = _timed_stream(lake, _calls(lake), "stream_admit")
    return _decisions(lake, out, J.admit_stream(
        calls, "user_id", ADMIT_LIMIT, ADMIT_HOURS * 3600, WHOLE_RANGE))
