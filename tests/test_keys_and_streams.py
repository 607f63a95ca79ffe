"""Rows that share keywords, lack a platform, change twice or arrive out of order."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatterlake import storage
from chatterlake.functions.times import parse_posted_at
from chatterlake.operators import budget, lifecycle, serve, silver
from chatterlake.plans.refresh import full_refresh
from chatterlake.sources import normalise
from chatterlake.streaming import streams

DAY = dt.date(2024, 1, 5)


def test_rows_keep_their_request(spark):
    runs = spark.createDataFrame(
        [("run1", "a", dt.datetime(2024, 1, 5, 3)), ("run2", "a", dt.datetime(2024, 1, 5, 9)),
         ("run3", "b", dt.datetime(2024, 1, 5, 1))],
        "id string, search_request_id string, started_at timestamp_ntz")
    crawled = spark.createDataFrame(
        [(1, "a", "k", DAY), (2, "b", "k", DAY), (3, "b", "k", dt.date(2024, 1, 6))],
        "id long, request_id string, keyword string, crawl_day date")
    rows = normalise.assign_lineage_ids(crawled, runs).orderBy("id").collect()
    assert [(r.search_request_id, r.crawl_run_id) for r in rows] == [("a", "run2"), ("b", "run3"), ("b", None)]


def test_platform_may_be_missing(spark):
    items = spark.createDataFrame(
        [(None, '{"id": "1", "text": "x", "author_id": "u"}'), ("facebook", '{"id": "2", "text": "y", "author_id": "u"}')],
        "platform string, item string").withColumns(
            {"start_date": F.lit("2024-01-01").cast("date"), "end_date": F.lit("2024-02-01").cast("date")})
    rows = normalise.route_by_platform(items).collect()
    assert sorted(r.platform_id for r in rows) == ["1", "2"]
    assert {r.platform for r in rows} == {None, "facebook"}


def test_campaigns_of_one_keyword_stay_apart(spark):
    analytics = spark.createDataFrame(
        [("a", "k", 1, 2, 3, 4), ("b", "k", 5, 6, 7, 8)],
        "search_request_id string, keyword string, total_likes long, total_shares long,"
        " total_replies long, total_views long")
    wide = serve.engagement_comparison(analytics)
    long = serve.melt_metrics(wide, ["search_request_id", "campaign"], ["likes", "views"])
    assert long.filter("search_request_id = 'b' AND metric = 'likes'").first().value == 5.0
    assert long.count() == 4
    posts = spark.createDataFrame(
        [("a", dt.datetime(2024, 1, 5)), ("b", dt.datetime(2024, 1, 5))],
        "search_request_id string, posted_at timestamp_ntz")
    assert sorted(r["count"] for r in serve.volume_comparison(analytics, posts).collect()) == [1, 1]


def test_last_change_counts(spark):
    jobs = spark.createDataFrame(
        [("j", "pending", None, None, None)],
        "id string, status string, error_message string, started_at timestamp_ntz, completed_at timestamp_ntz")
    changes = spark.createDataFrame(
        [("j", "running", None, dt.datetime(2024, 1, 1)), ("j", "failed", "E", dt.datetime(2024, 1, 2))],
        "id string, status string, error_message string, at timestamp_ntz")
    rows = lifecycle.set_job_status(jobs, changes).collect()
    assert [(r.status, r.error_message, r.completed_at) for r in rows] == [("failed", "E", dt.datetime(2024, 1, 2))]
    attempts = spark.createDataFrame([("j", 1), ("j", 2)], "id string, attempts int")
    assert [r.attempts for r in lifecycle.set_attempts(jobs.withColumn("attempts", F.lit(0)), attempts).collect()] == [2]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_times_in_a_clock_change(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        texts = ["2024-03-10T02:30:00Z", "2024-11-03T01:30:00-05:00", "1969-12-31T23:59:58.5Z"]
        df = spark.createDataFrame([(t,) for t in texts], "t string")
        got = [r[0] for r in df.select(parse_posted_at(F.col("t")).cast("string")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == ["2024-03-10 02:30:00", "2024-11-03 06:30:00", "1969-12-31 23:59:58.5"]


def test_odd_field_is_no_broken_payload(spark):
    raw = ['{"text": "t", "hashtags": "x"}', '{"text": "t", "public_metrics": []}', "{", None]
    bronze = spark.createDataFrame(
        [(i, "s", "c", "twitter", str(i), "h", p, dt.datetime(2024, 1, 1)) for i, p in enumerate(raw)],
        "id long, search_request_id string, crawl_run_id string, platform string, platform_id string,"
        " author_handle string, raw_payload string, fetched_at timestamp_ntz")
    rows = silver.silver_extract(bronze, keep_extras=True).orderBy("id").collect()
    assert [r.payload_error is None for r in rows] == [True, True, False, True]
    assert [r.post_text for r in rows[:2]] == ["t", "t"]


def test_keys_with_nulls_are_no_duplicates(spark):
    posts = spark.createDataFrame(
        [(1, "x", None, 1), (2, "x", None, 2), (3, "x", "k", 3), (4, "x", "k", 4), (3, "x", "k", 3)],
        "id long, platform string, platform_id string, fetched_at int")
    assert sorted(r.id for r in silver.dedup_posts(posts).collect()) == [1, 2, 3]


def _stream_of(spark, name, files):
    path = storage.fresh_path(spark, name)
    schema = "id long, client string, ts timestamp_ntz"
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    table = spark.read.schema(schema).parquet(f"{path}/in")
    return path, table, streams.read_stream(spark, table, f"{path}/in", 1)


def _at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_admission_follows_event_time_over_triggers_and_restarts(spark):
    late = [(10, "c", _at(10)), (11, "c", _at(11)), (12, "c", _at(12))]
    early = [(0, "c", _at(0)), (1, "c", _at(1)), (2, "c", _at(2)), (20, "d", _at(3))]
    path, _, calls = _stream_of(spark, "admission", [late, early, [(99, "z", _at(9000))]])
    decided = streams.admit_stream(calls, "client", 3, 60, "1 minute")
    for _ in range(2):  # the second start finds nothing new and replays nothing
        streams.start(decided, f"{path}/state", f"{path}/out").awaitTermination()
    got = {r.id: r.admitted for r in spark.read.parquet(f"{path}/out").collect()}
    batch = spark.createDataFrame(late + early, "id long, client string, ts timestamp_ntz")
    expected = {r.id: r.admitted for r in budget.admit_sliding(batch, "client", "ts", "id", 3, 60).collect()}
    assert {i: got[i] for i in expected} == expected and not expected[10] and expected[0]


def test_a_refused_start_does_not_prolong(spark):
    files = [[(i, "k", _at(200 * i))] for i in range(5)] + [[(99, "z", _at(9000))]]
    path, table, starts = _stream_of(spark, "ttl", files)
    starts = starts.withColumnRenamed("client", "dedup_key")
    decided = streams.repeat_requests_stream(starts, 300, "10 seconds")
    streams.start(decided, f"{path}/state", f"{path}/out").awaitTermination()
    got = {r.id: r.admitted for r in spark.read.parquet(f"{path}/out").collect() if r.id < 99}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: True}


def test_refresh_into_one_folder_leaves_one_copy(spark, lake, tmp_path):
    work = str(tmp_path / "work")
    sizes = []
    for _ in range(2):
        full_refresh(lake.raw_posts, lake.search_requests, F.lit("2024-02-01").cast("timestamp_ntz"), work)
        sizes.append(sorted(p.name for p in (tmp_path / "work").iterdir()))
        files = len(list((tmp_path / "work" / "scored_posts").glob("*.parquet")))
    assert sizes[0] == sizes[1] and files > 0
    storage.discard(spark, work)
    assert not (tmp_path / "work").exists()


def test_keyword_reads_partitions_of_its_campaigns(lake):
    plan = serve.filter_posts(lake.gold_post_search, "click", requests=lake.search_requests)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in text or "PartitionFilters: [isnotnull" in text
