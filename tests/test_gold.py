"""Golden numbers of the gold tables and rebuild invariants."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from chatterlake import schemas
from chatterlake.operators import gold as G
from chatterlake.operators import serve as V
from chatterlake.plans.export import write_gold_partitioned


def post(i, **over):
    row = dict(
        id=i, search_request_id="sr", keyword="python", platform="twitter", author_handle="h",
        author_name=None, post_text="text", posted_at=datetime(2025, 1, 15, 10),
        post_url=None, sentiment="positive", sentiment_confidence=0.9, topic_label="technology",
        topic_confidence=None, language="en", hashtags=["python"], mentions=[], like_count=10,
        share_count=5, reply_count=2, view_count=100, ai_version=1,
        created_at=datetime(2025, 1, 20),
    )
    row.update(over)
    return tuple(row[c] for c in schemas.GOLD_POSTS)


def gold(spark, *posts):
    return spark.createDataFrame(list(posts), schemas.struct_of("gold_post_search"))


@pytest.fixture
def requests(spark):
    rows = [(k, k, date(2025, 1, 1), date(2025, 1, 31), "twitter", "completed", 0, None, None)
            for k in ("sr", "none")]
    return spark.createDataFrame(rows, schemas.struct_of("search_requests"))


def test_daily_numbers(spark):
    rows = G.campaign_daily(gold(
        spark, post(1), post(2, sentiment="negative", hashtags=["data"]),
        post(3, posted_at=datetime(2025, 1, 16)), post(4, posted_at=None),
    )).orderBy("date").collect()
    assert len(rows) == 2
    first = rows[0]
    assert (first.total_posts, first.positive_count, first.negative_count) == (2, 1, 1)
    assert (first.total_likes, first.total_shares, first.total_replies, first.total_views) == (
        20, 10, 4, 200)
    assert first.top_hashtags == ["data", "python"]


def test_summary_numbers(spark, requests):
    rows = {r.search_request_id: r for r in G.campaign_summary(gold(
        spark, post(1), post(2, sentiment="negative", platform="facebook"),
        post(3, sentiment="neutral"),
    ), requests).collect()}
    full, empty = rows["sr"], rows["none"]
    assert (full.positive_pct, full.negative_pct, full.neutral_pct) == (33.33, 33.33, 33.33)
    assert (full.avg_confidence, full.total_engagement) == (0.9, 51)
    assert full.platforms == ["facebook", "twitter"]
    assert (full.start_date, full.end_date) == (date(2025, 1, 1), date(2025, 1, 31))
    assert (empty.total_posts, empty.positive_pct, empty.platforms) == (0, None, [])


def test_confidence_all_null(spark, requests):
    posts = gold(spark, post(1, sentiment_confidence=None))
    assert G.campaign_summary(posts, requests).filter("total_posts = 1").first(
    ).avg_confidence is None
    assert G.campaign_summary_sql(posts).first().avg_confidence == 0.0


def test_top_five_breaks_ties_by_item(spark):
    tags = [["b", "a"], ["c", "d"], ["e", "f"], ["f"]]
    posts = gold(spark, *[post(i, hashtags=t) for i, t in enumerate(tags)])
    row = G.top_lists(posts, ["search_request_id"]).first()
    assert row.top_hashtags == ["f", "a", "b", "c", "d"]


def test_daily_sql_keeps_every_tag(spark):
    """Lists hold each hashtag and topic as often as it occurs, also for days and keywords that are NULL."""
    undated = dict(posted_at=None, keyword=None)
    rows = {r.date: r for r in G.campaign_daily_sql(gold(
        spark, post(1, hashtags=["b", "a", "b"]), post(2, hashtags=["a"], topic_label=""),
        post(3, hashtags=None, topic_label="art"), post(4, hashtags=["z"], **undated),
        post(5, hashtags=["z", "y"], topic_label=None, **undated),
        post(6, hashtags=[], topic_label=None, posted_at=datetime(2025, 1, 16)),
    )).collect()}
    day, null, bare = rows[date(2025, 1, 15)], rows[None], rows[date(2025, 1, 16)]
    assert (day.top_hashtags, day.top_topics) == (["a", "a", "b", "b"], ["art", "technology"])
    assert (null.top_hashtags, null.top_topics) == (["y", "z", "z"], ["technology"])
    assert (bare.top_hashtags, bare.top_topics) == ([], [])
    assert [(r.total_posts, r.hashtag_count, r.topic_count) for r in (day, null, bare)] == [
        (3, 4, 2), (2, 3, 1), (1, 0, 0)]


def test_search_pages_and_ranges(spark):
    posts = gold(
        spark, post(1, post_text="I love Python programming"),
        post(2, post_text="Java is great too"),
        post(3, post_text="python", posted_at=datetime(2025, 3, 15)),
    )
    page = V.search_posts(posts, limit=1, keyword="python")
    assert [r.id for r in page.rows.collect()] == [3]
    assert page.total.first().total == 2
    ranged = V.matching_posts(posts, start="2025-01-01", end="2025-02-28 23:59:59")
    assert ranged.count() == 2
    assert V.matching_posts(posts, start="2025-01-01").count() == 3
    assert V.filter_posts(posts, "python", date_to="2025-01-15 10:00:00").count() == 0


def test_incremental_build_equals_full_build(lake):
    path = lake.fresh("incremental")
    args = lake.silver_posts, lake.silver_ai_enrichment, lake.search_requests
    cut = F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz")
    write_gold_partitioned(G.gold_post_search(args[0].filter(cut), *args[1:]), path)
    part = G.incremental_gold(*args, lake.gold_build_tracking)
    result = write_gold_partitioned(part, path).select(*schemas.GOLD_POSTS)
    full = G.gold_post_search(*args).select(*schemas.GOLD_POSTS)
    assert result.count() == full.count()
    assert result.exceptAll(full).count() == 0


def test_daily_adds_up_to_summary(lake):
    daily = lake.gold_campaign_daily.groupBy("search_request_id").agg(
        F.sum("total_posts").alias("n"))
    both = daily.join(lake.gold_campaign_summary, "search_request_id")
    undated = lake.gold_post_search.filter("posted_at IS NULL").count()
    assert undated == 0
    assert both.filter("n <> total_posts").count() == 0


def test_schema_versions():
    assert "topic_confidence" not in schemas.columns_at("gold_post_search", 1)
    assert "lineage_updated_at" in schemas.columns_at("gold_campaign_daily")
    assert schemas.columns_at("gold_build_tracking", 2) == {}
    with pytest.raises(ValueError):
        schemas.columns_at("gold_post_search", 0)
