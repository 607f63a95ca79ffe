"""First arrivals, the daily table and retries as streams: late files, restarts and odd rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatterlake import storage
from chatterlake.operators import gold as G
from chatterlake.streaming import streams


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def stream_of(spark, name, schema, files):
    """A folder of one file each, read a file a trigger."""
    path = storage.fresh_path(spark, name)
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    return path, streams.read_stream(spark, spark.read.schema(schema).parquet(f"{path}/in"), f"{path}/in", 1)


POSTS = "id long, platform string, platform_id string, ts timestamp_ntz"


def test_first_arrivals_over_late_files_and_restarts(spark):
    late = [(3, "a:b", "c", at(30)), (4, "a", "b:c", at(31)), (5, "x", None, at(32))]
    early = [(1, "a:b", "c", at(1)), (2, "a", "b:c", at(1)), (6, "x", None, at(2)), (7, None, "y", at(3)), (8, "a:b", "c", at(1))]
    again = [(9, "a:b", "c", at(9000))]  # long after: a new first
    path, posts = stream_of(spark, "first", POSTS, [late, early, again, [(99, "z", "z", at(99_000))]])
    first = streams.first_arrivals_stream(posts, ["platform", "platform_id"], "10 minutes", "5 minutes")
    assert "Python" not in first._jdf.queryExecution().analyzed().toString()
    for _ in range(2):  # the second start finds nothing new and gives out nothing twice
        streams.start(first, f"{path}/state", f"{path}/out").awaitTermination()
    got = sorted(r.id for r in spark.read.parquet(f"{path}/out").collect())
    assert got == [1, 2, 5, 6, 7, 9]


GOLD = ("id long, search_request_id string, keyword string, platform string, posted_at timestamp_ntz, sentiment string,"
        " sentiment_confidence double, topic_label string, hashtags array<string>, like_count long, share_count long,"
        " reply_count long, view_count long, ai_version int")


def post(i, day, tags=("x",), sentiment="positive", topic="tea", confidence=0.25):
    moment = None if day is None else dt.datetime(2024, 1, day, 9) + dt.timedelta(seconds=i)
    return (i, "a" if i % 3 else "b", "k", "twitter", moment, sentiment, confidence, topic, tags and list(tags), i, 1, 2, 3, 1)


def test_days_are_given_out_once_with_their_top_lists(spark):
    one = [post(i, 5, (f"t{i % 7}", "x", "x")) for i in range(40)] + [post(50, None), post(51, 5, None, None, "", None)]
    two = [post(i, 6, [f"t{i}"], "negative") for i in range(60, 90)] + [post(91, 5, [])]
    path, posts = stream_of(spark, "days", GOLD, [one, two, [post(999, 28)]])
    table = streams.daily_table_stream(posts, "2 days", buckets=4)
    assert "Python" not in table._jdf.queryExecution().analyzed().toString()
    for _ in range(2):
        streams.start(table, f"{path}/state", f"{path}/out").awaitTermination()
    got = spark.read.schema(table.schema).parquet(f"{path}/out")
    expected = G.campaign_daily(spark.createDataFrame(one + two, GOLD)).select(*table.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


BRONZE = ("id long, search_request_id string, crawl_run_id string, platform string, platform_id string,"
          " author_handle string, raw_payload string, fetched_at timestamp_ntz")


def raw(i, payload, minute):
    return (i, "s", "c", "twitter", str(i), "h", payload, at(60 * minute))


@pytest.mark.parametrize("together", [False, True])
def test_attempts_go_on_and_end(spark, together):
    good, bad = '{"text": "t"}', "{"
    files = [[raw(1, good, 0), raw(2, bad, 0), raw(3, bad, 0)], [raw(2, good, 1), raw(3, bad, 1)], [raw(3, bad, 2), raw(2, bad, 2)],
             [raw(3, good, 3), raw(1, bad, 3)]]
    if together:  # the tries of one batch count one by one
        files = [files[0], [row for rows in files[1:3] for row in rows]]
        files[1] = [row for row in files[1] if row[6] != bad or row[0] == 3]
    path, bronze = stream_of(spark, "tries", BRONZE, files)
    sink = streams.lifecycle_sink(f"{path}/silver", f"{path}/jobs", f"{path}/rejected")
    streams.start(bronze, f"{path}/state", sink).awaitTermination()
    jobs = spark.read.parquet(f"{path}/jobs")
    got = {r.silver_post_id: (r.status, r.attempts, r.dead) for r in streams.job_states(jobs).collect()}
    assert got == {1: ("completed", 1, False), 2: ("completed", 2, False), 3: ("failed", 3, True)}
    sink(spark.createDataFrame(files[-1], BRONZE), len(files) - 1)  # the last batch once more
    again = {r.silver_post_id: (r.status, r.attempts, r.dead) for r in streams.job_states(spark.read.parquet(f"{path}/jobs")).collect()}
    assert again == got


def test_tries_keep_no_copy_of_the_payloads(spark, tmp_path, monkeypatch):
    def persist(*_):
        raise AssertionError("payloads are kept")

    monkeypatch.setattr(type(spark.range(1)), "persist", persist)
    sink = streams.lifecycle_sink(*[str(tmp_path / p) for p in ("silver", "jobs", "rejected")], max_attempts=2)
    schema = ("id long, search_request_id string, crawl_run_id string, platform string, platform_id string, "
              "author_handle string, raw_payload string, fetched_at timestamp_ntz")
    at = [dt.datetime(2024, 1, d) for d in (1, 2, 3)]

    def post(i, payload, when):
        return (i, "sr", "cr", "twitter", f"p{i}", "u", payload, when)

    sink(spark.createDataFrame([post(1, "{", at[0]), post(2, '{"text": "a"}', at[0]), post(3, "{", at[0]),
                                post(3, '{"text": "b"}', at[1]), post(None, "{}", at[0])], schema), 0)
    sink(spark.createDataFrame([post(1, '{"text": "c"}', at[1]), post(2, "{", at[1]), post(4, "{", at[1])], schema), 1)
    sink(spark.createDataFrame([post(4, "{", at[2]), post(4, "{", at[2])], schema), 2)
    sink(spark.createDataFrame([post(4, "{}", at[2])], schema), 3)
    jobs = spark.read.parquet(str(tmp_path / "jobs")).select("batch_id", "silver_post_id", "status", "attempts")
    assert sorted(map(tuple, jobs.collect())) == [
        (0, 1, "failed", 1), (0, 2, "completed", 1), (0, 3, "completed", 2), (1, 1, "completed", 2),
        (1, 4, "failed", 1), (2, 4, "failed", 2)]
    texts = spark.read.parquet(str(tmp_path / "silver")).select("batch_id", "id", "post_text")
    assert {tuple(r) for r in texts.collect() if r.post_text} == {(0, 2, "a"), (0, 3, "b"), (1, 1, "c")}
    rejected = spark.read.parquet(str(tmp_path / "rejected")).select("batch_id", "id")
    assert sorted(map(tuple, rejected.collect())) == [(0, 1), (1, 4), (2, 4)]
