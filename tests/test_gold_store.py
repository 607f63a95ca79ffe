"""Gold tables kept up by merged batches: repeats, replays, crashes and compaction."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chatterlake import storage
from chatterlake.operators import gold as G
from chatterlake.operators import partials as P
from chatterlake.streaming.gold_store import GoldStore

SCHEMA = ("id long, search_request_id string, keyword string, platform string, author_handle string, author_name string,"
          " post_text string, posted_at timestamp_ntz, post_url string, sentiment string, sentiment_confidence double,"
          " topic_label string, topic_confidence double, language string, hashtags array<string>, mentions array<string>,"
          " like_count long, share_count long, reply_count long, view_count long, ai_version int, created_at timestamp_ntz")


def at():
    return F.lit("2024-02-01").cast("timestamp_ntz")


def post(id, campaign="a", day=5, sentiment="positive", confidence=0.5, tags=("x",), likes=1, version=1, built=1):
    posted = None if day is None else dt.datetime(2024, 1, day, 10)
    return (id, campaign, campaign and f"k {campaign}", "twitter" if id % 2 else "reddit", None, None, f"text {id}", posted, None,
            sentiment, confidence, "tea", 0.5, "en", list(tags), [], likes, 0, 0, 0, version, dt.datetime(2024, 1, 20, built))


@pytest.fixture
def requests(spark):
    day = dt.date(2024, 1, 1)
    return spark.createDataFrame([(c, f"k {c}", day, day) for c in ("a", "b/c=d", "unused")],
                                 "id string, keyword string, start_date date, end_date date")


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def check(store, spark, requests, posts):
    """The store holds what one build over ``posts`` gives."""
    gold = spark.createDataFrame(posts, SCHEMA)
    assert rows(store.posts()) == rows(gold)
    assert rows(store.daily()) == rows(G.campaign_daily(gold, at=at()))
    assert rows(store.summary()) == rows(G.campaign_summary(gold, requests, at=at()).filter("total_posts > 0"))


FIRST = [post(1), post(2, tags=("y", "x")), post(3, day=6, sentiment=None, confidence=None), post(4, "b/c=d", tags=()),
         post(5, day=None), post(6, day=7, tags=("ü", "ü"))]
SECOND = [post(2, likes=9, built=2), post(7), post(8, "b/c=d", day=9), post(9, day=None, sentiment="negative")]


def test_batches_add_up_to_one_build(spark, requests):
    store = GoldStore(spark, storage.fresh_path(spark, "store"), requests, at())
    store.merge(spark.createDataFrame(FIRST, SCHEMA), 0)
    check(store, spark, requests, FIRST)
    store.merge(spark.createDataFrame(SECOND, SCHEMA), 1)
    both = [p for p in FIRST if p[0] != 2] + SECOND
    check(store, spark, requests, both)
    store.merge(spark.createDataFrame(SECOND, SCHEMA), 1)  # replayed
    check(store, spark, requests, both)
    store.merge(spark.createDataFrame([], SCHEMA), 2)  # an empty batch
    check(store, spark, requests, both)
    store.vacuum()
    check(store, spark, requests, both)
    kept = spark.read.parquet(f"{store.root}/posts").select("part_campaign", "part_day", "version").distinct()
    assert kept.count() == kept.select("part_campaign", "part_day").distinct().count()
    with pytest.raises(ValueError):
        store.merge(spark.createDataFrame(FIRST, SCHEMA), 1)


def test_a_crash_before_the_manifest_changes_nothing(spark, requests, monkeypatch):
    store = GoldStore(spark, storage.fresh_path(spark, "store"), requests, at())
    store.merge(spark.createDataFrame(FIRST, SCHEMA), 0)

    def fail(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", fail)
        with pytest.raises(OSError):
            store.merge(spark.createDataFrame(SECOND, SCHEMA), 1)
    check(store, spark, requests, FIRST)
    store.merge(spark.createDataFrame(SECOND, SCHEMA), 1)
    check(store, spark, requests, [p for p in FIRST if p[0] != 2] + SECOND)


def test_repeats_within_a_batch_and_an_empty_store(spark, requests):
    store = GoldStore(spark, storage.fresh_path(spark, "store"), requests, at())
    with pytest.raises(FileNotFoundError):
        store.posts()
    store.merge(spark.createDataFrame([post(1, built=1), post(1, likes=5, built=3), post(1, likes=7, built=2)], SCHEMA), 4)
    check(store, spark, requests, [post(1, likes=5, built=3)])


def test_only_touched_partitions_are_written_again(spark, requests):
    store = GoldStore(spark, storage.fresh_path(spark, "store"), requests, at())
    store.merge(spark.createDataFrame(FIRST, SCHEMA), 0)
    store.merge(spark.createDataFrame([post(7)], SCHEMA), 1)
    written = spark.read.parquet(f"{store.root}/posts/version=1").select("part_campaign", "part_day").distinct().collect()
    assert [(r.part_campaign, str(r.part_day)) for r in written] == [("c-a", "2024-01-05")]
    plan = store.posts()._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan and "Window" not in plan


def test_parts_add_up(spark, requests):
    one, two = spark.createDataFrame(FIRST, SCHEMA), spark.createDataFrame([post(20, day=6), post(21, likes=3)], SCHEMA)
    whole = one.unionByName(two)
    parts = P.day_parts(one).unionByName(P.day_parts(two))
    items = P.item_parts(one).unionByName(P.item_parts(two))
    assert rows(P.daily_of(parts, items, at=at())) == rows(G.campaign_daily(whole, at=at()))
    assert rows(P.summary_of(parts, items, requests, at=at())) == rows(G.campaign_summary(whole, requests, at=at()))
