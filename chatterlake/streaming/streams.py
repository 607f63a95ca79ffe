"""The same transforms as Structured Streaming queries.

Polling loops become file streams, the "not processed yet" join becomes the stream checkpoint.
Checkpoints and outputs live in the shared folder, so a restarted query continues where it was.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from chatterlake import storage
from chatterlake.functions import numbers as N
from chatterlake.functions import text as X
from chatterlake.functions.times import epoch_micros, instant, to_utc
from chatterlake.operators import gold as G
from chatterlake.operators.silver import payload_error, silver_extract
from chatterlake.sources.payload import with_payload

# Poll intervals and late-data allowances.
ENRICH_INTERVAL = "30 seconds"
CRAWL_INTERVAL = "15 seconds"
DAILY_DELAY = "2 days"
TOKEN_DELAY = "25 hours"
REPEAT_DELAY = "5 minutes"
REPEAT_SECONDS = 300
MAX_ATTEMPTS = 3


def read_stream(
    spark: SparkSession, table: DataFrame, path: str, files_per_trigger: int = 1000
) -> DataFrame:
    """File stream over a table's folder with the schema of ``table``."""
    return (
        spark.readStream.schema(table.schema)
        .option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    )


def start(
    stream: DataFrame, checkpoint: str, sink: Callable[[DataFrame, int], None] | str,
    mode: str = "append", interval: str | None = None,
) -> StreamingQuery:
    """Start a query into a Parquet folder or a batch function.

    Without an interval it processes what is there and stops.
    """
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    writer = (
        writer.trigger(processingTime=interval) if interval
        else writer.trigger(availableNow=True)
    )
    if isinstance(sink, str):
        return writer.format("parquet").option("path", sink).start()
    return writer.foreachBatch(sink).start()


def batch_folder(path: str) -> Callable[[DataFrame, int], None]:
    """Sink that keeps each micro-batch in its own partition; a replay overwrites it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
        )

    return write


def latest_state(changes: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of each key from a folder written by :func:`batch_folder`.

    Nothing but the newest row per key and task is shuffled.
    """
    newest = Window.partitionBy(*keys).orderBy(F.desc("batch_id"))
    return (
        changes.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1")
        .drop("_rank", "batch_id")
    )


def watermarked(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Add ``event_time``, the instant of a zone-less UTC column, with a watermark on it."""
    return stream.withColumn("event_time", instant(F.col(time))).withWatermark(
        "event_time", delay
    )


def silver_stream(bronze: DataFrame) -> DataFrame:
    """Bronze stream to silver rows: stateless, so append works without a watermark."""
    return silver_extract(bronze)


def pending_requests_stream(requests: DataFrame) -> DataFrame:
    return requests.filter("status = 'pending'")


def first_arrivals_stream(
    posts: DataFrame, key: list[str], gap: str = DAILY_DELAY, delay: str = DAILY_DELAY
) -> DataFrame:
    """First post of each key by time and id, in event time: the key columns, ts, id.

    Posts (``key``, ts, id) of one key that follow each other within ``gap`` are repeats of the first of
    them, which is given out once the watermark has passed their last one by ``gap``; so files and
    triggers do not change the result. The state is one row a key. A post whose key has a NULL part
    repeats no other and is given out after the same wait.
    """
    alone = F.when(reduce(or_, [F.col(c).isNull() for c in key]), F.col("id"))
    return (
        watermarked(posts, "ts", delay)
        .groupBy(F.session_window("event_time", gap), *key, alone.alias("alone"))
        .agg(F.min(F.struct("ts", "id")).alias("first"))
        .select(*key, "first.ts", "first.id")
    )


def repeat_requests_stream(
    starts: DataFrame, ttl_seconds: int = REPEAT_SECONDS, delay: str = REPEAT_DELAY
) -> DataFrame:
    """Start requests (dedup_key, ts, id) with ``admitted``: false within the time to live of the last
    accepted start of the same key. A refused start does not prolong it."""
    return admit_stream(starts, "dedup_key", 1, ttl_seconds, delay)


def daily_stream(posts: DataFrame, delay: str = DAILY_DELAY) -> DataFrame:
    """Daily figures as gold posts arrive, with the measures of the daily table.

    State of a day is dropped after the delay; in append mode a day is given out then.
    """
    day = F.window("event_time", "1 day")
    return (
        watermarked(posts, "posted_at", delay)
        .groupBy(day.alias("w"), "search_request_id", "platform").agg(*G.measures())
        .withColumn("date", F.to_date(to_utc(F.col("w.start")))).drop("w")
    )


def daily_tags_stream(posts: DataFrame, kind: str, delay: str = DAILY_DELAY) -> DataFrame:
    """Uses of each hashtag or topic per campaign, platform and day, from which the day's top list
    is ranked. One state row per item; no list is held."""
    item = F.explode("hashtags") if kind == "hashtag" else F.col("topic_label")
    day = F.window("event_time", "1 day")
    return (
        watermarked(posts, "posted_at", delay)
        .select("event_time", "search_request_id", "platform", item.alias("item"))
        .filter("item IS NOT NULL AND item <> ''")
        .groupBy(day.alias("w"), "search_request_id", "platform", "item")
        .agg(F.count(F.lit(1)).alias("count"))
        .withColumn("date", F.to_date(to_utc(F.col("w.start")))).drop("w")
    )


def daily_table_stream(posts: DataFrame, delay: str = DAILY_DELAY, n: int = 5, buckets: int = 32) -> DataFrame:
    """Rows of the daily table with their top lists, each given out once: append mode.

    Three windowed aggregations in a row: items are counted, the top of each hash bucket of a day's items
    is kept, and the tops of the buckets are merged. A day with many posts or items is spread by item
    and then by bucket. A day closes when the watermark passes its end; later posts are dropped.
    """
    keys = ["search_request_id", "platform"]

    def entry(kind: str, item: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), item.alias("item"))

    topic = X.present(F.col("topic_label"))
    nothing = F.array().cast("array<struct<kind:string,item:string>>")
    entries = F.concat(
        # the post itself, spread over the buckets
        F.array(entry("post", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("string"))),
        F.transform(F.coalesce("hashtags", F.array().cast("array<string>")), lambda t: entry("hashtag", t)),
        F.coalesce(F.when(topic.isNotNull(), F.array(entry("topic", F.col("topic_label")))), nothing),
    )
    confidence = F.col("sentiment_confidence")
    measured = {
        "total_posts": F.lit(1),
        **{f"{s}_count": F.col("sentiment").eqNullSafe(s).cast("int") for s in ("positive", "negative", "neutral")},
        "confidence_sum": confidence.cast("decimal(18,6)"), "confidence_count": confidence.isNotNull().cast("int"),
        **{f"total_{m}": F.col(c) for m, c in [("likes", "like_count"), ("shares", "share_count"),
                                               ("replies", "reply_count"), ("views", "view_count")]},
    }
    rows = watermarked(posts, "posted_at", delay).select(
        "event_time", *keys, "keyword", "ai_version", *[c.alias(m) for m, c in measured.items()], F.explode(entries).alias("e"))
    own = F.col("e.kind") == "post"
    counted = rows.groupBy(F.window("event_time", "1 day"), *keys, "e.kind", "e.item").agg(
        F.count(F.lit(1)).alias("count"), F.max(F.when(own, F.col("keyword"))).alias("keyword"),
        F.max(F.when(own, F.col("ai_version"))).alias("ai_version"),
        *[F.sum(F.when(own, F.col(m))).alias(m) for m in measured])
    kinds = {"hashtag": "top_hashtags", "topic": "top_topics"}

    def day() -> Column:
        return F.window(F.window_time("window"), "1 day")

    def merged() -> list[Column]:
        return [F.max("keyword").alias("keyword"), F.max("ai_version").alias("ai_version"),
                *[F.sum(m).alias(m) for m in measured]]

    def first(entries: Column) -> Column:
        return F.slice(F.array_sort(entries), 1, n)

    ranked = F.struct((-F.col("count")).alias("uses"), "item")
    tops = counted.groupBy(day(), *keys, F.pmod(F.xxhash64("item"), F.lit(buckets)).alias("bucket")).agg(
        *merged(), *[F.collect_list(F.when(F.col("kind") == kind, ranked)).alias(name) for kind, name in kinds.items()]
    ).withColumns({name: first(F.col(name)) for name in kinds.values()})
    whole = tops.groupBy(day(), *keys).agg(*merged(), *[F.collect_list(name).alias(name) for name in kinds.values()])
    return whole.select(
        "search_request_id", "keyword", "platform", F.to_date(to_utc(F.col("window.start"))).alias("date"),
        "total_posts", "positive_count", "negative_count", "neutral_count",
        N.ratio(F.col("confidence_sum").cast("double"), F.col("confidence_count"), 4).alias("avg_confidence"),
        *[F.transform(first(F.flatten(name)), lambda e: e["item"]).alias(name) for name in kinds.values()],
        "total_likes", "total_shares", "total_replies", "total_views", "ai_version",
    )


def token_stream(events: DataFrame, delay: str = TOKEN_DELAY) -> DataFrame:
    """Tokens per hour; in append mode an hour is given out once, when the delay has passed."""
    return (
        watermarked(events, "ts", delay).groupBy(F.window("event_time", "1 hour").alias("w"))
        .agg(F.sum("tokens").alias("hour_tokens"))
        .select(to_utc(F.col("w.start")).alias("hour"), "hour_tokens")
    )


def lifecycle_sink(silver_path: str, jobs_path: str, rejected_path: str, max_attempts: int = MAX_ATTEMPTS):
    """Batch function that stores silver rows, one job row per tried post and the rejected rows.

    A readable payload completes, any other fails, keeps its silver row and goes to the rejected folder with
    its error. A post that arrives again after a failure is tried again: attempts go on from the
    post's stored jobs, of which ids and numbers are read. A post that is completed or has used up
    ``max_attempts`` is left alone. Of a batch's rows with one id each is a try, in the order of their
    arrival, and the last one is stored.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        tries = Window.partitionBy("id").orderBy("fetched_at", "raw_payload")
        ids = batch.filter("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("_n"))
        aside = ids.filter("_n > 1").select("id")
        before = None
        if storage.children(spark, jobs_path):
            stored = spark.read.parquet(jobs_path).filter(F.col("batch_id") < batch_id)
            before = stored.groupBy(F.col("silver_post_id").alias("id")).agg(
                F.max("attempts").alias("_before"), F.bool_or(F.col("status") == "completed").alias("_done"))
            aside = aside.unionByName(ids.join(before, "id", "left_semi").select("id"))
        # written, so Spark knows how few they are before it decides how to part them from the others
        path = storage.fresh_path(spark, "tried-ids")
        aside = storage.write_table(aside.distinct(), path).select(F.col("id").alias("_tried"))
        is_tried = F.col("id") == F.col("_tried")
        new = batch.filter("id IS NOT NULL").join(aside, is_tried, "left_anti").withColumn(
            "_attempts", F.least(F.lit(1), F.lit(max_attempts)))
        due = batch.join(aside, is_tried, "left_semi").withColumn("_try", F.row_number().over(tries)).withColumn(
            "_last", F.lead("_try").over(tries).isNull()).filter("_last").drop("_last")
        if before is None:
            due = due.withColumn("_attempts", F.least(F.col("_try"), F.lit(max_attempts)))
        else:
            new = new.filter(F.lit(max_attempts > 0))
            due = due.join(before, "id", "left").filter(
                f"NOT coalesce(_done, false) AND coalesce(_before, 0) < {max_attempts}").withColumn(
                "_attempts", F.least(F.coalesce("_before", F.lit(0)) + F.col("_try"), F.lit(max_attempts))
            )
        due = new.unionByName(due.select(*new.columns))
        rows = silver_extract(due, keep_extras=True, keep=["_attempts"])
        error = F.col("payload_error")
        typed = rows.drop("payload_hashtags", "payload_mentions", "payload_error", "_attempts")
        jobs = rows.select(
            F.concat(F.lit("job-"), F.col("id").cast("string")).alias("id"),
            F.col("id").alias("silver_post_id"),
            F.when(error.isNull(), F.lit("completed")).otherwise(F.lit("failed")).alias("status"),
            F.col("_attempts").alias("attempts"), error.alias("error_message"),
        )
        bad = with_payload(due).withColumn("payload_error", payload_error(F.col("p"))).filter(
            error.isNotNull()).select(*batch.columns, "payload_error")
        # each parses the payloads anew: to keep them would write every text once more
        for df, path in [(typed, silver_path), (bad, rejected_path), (jobs, jobs_path)]:
            batch_folder(path)(df, batch_id)

    return write


def job_states(jobs: DataFrame) -> DataFrame:
    """Last try of every post, with ``dead`` where it failed as often as it may."""
    last = jobs.groupBy("id").agg(F.max(F.struct("attempts", "silver_post_id", "status", "error_message")).alias("j"))
    return last.select("id", "j.silver_post_id", "j.status", "j.attempts", "j.error_message").withColumn(
        "dead", (F.col("status") == "failed") & (F.col("attempts") >= MAX_ATTEMPTS))


def admit_stream(
    calls: DataFrame, client: str, max_requests: int, window_seconds: int,
    delay: str = REPEAT_DELAY,
) -> DataFrame:
    """Sliding-window admission, decided in event time.

    Columns: ``client``, ``ts``, ``id``. A call waits in the state of its client until the watermark
    has passed it, so calls are decided in the order of their times (ties by id) however files and
    triggers cut them, and the result is that of the batch operator. The state holds the calls of the
    last ``delay`` and at most ``max_requests`` admitted times. A call later than the
    watermark is dropped, as in every watermarked query.
    """
    width = window_seconds * 1_000_000
    source = watermarked(calls, "ts", delay).select(
        F.col(client).alias("client"), "event_time", "id", epoch_micros(F.col("ts")).alias("us")
    )

    def decide(
        key: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        held_us, held_id, recent = map(list, state.get) if state.exists else ([], [], [])
        for batch in batches:
            held_us += batch["us"].tolist()
            held_id += batch["id"].tolist()
        mark = state.getCurrentWatermarkMs()
        waiting = sorted(zip(held_us, held_id))
        due = bisect_right(waiting, mark * 1000, key=lambda x: x[0])
        admitted, times = [], deque(recent)
        for us, _ in waiting[:due]:
            while times and times[0] <= us - width:
                times.popleft()
            admitted.append(len(times) < max_requests)
            if admitted[-1]:
                times.append(us)
        rest = waiting[due:]
        if rest or (times and times[-1] + width > mark * 1000):
            state.update(([u for u, _ in rest], [i for _, i in rest], list(times)))
            wake = rest[0][0] if rest else times[-1] + width
            state.setTimeoutTimestamp(max(mark + 1, -(-wake // 1000)))
        elif state.exists:
            state.remove()
        if due:
            yield pd.DataFrame({"id": [i for _, i in waiting[:due]], "client": key[0],
                                "admitted": admitted})

    id_type = calls.schema["id"].dataType.simpleString()
    client_type = calls.schema[client].dataType.simpleString()
    return source.groupBy("client").applyInPandasWithState(
        decide, f"id {id_type}, client {client_type}, admitted boolean",
        f"held_us array<bigint>, held_id array<{id_type}>, recent array<bigint>", "append",
        GroupStateTimeout.EventTimeTimeout,
    )
