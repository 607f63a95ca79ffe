"""Payload edge cases of the silver projection and the tag functions."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from chatterlake.functions import text as X
from chatterlake.functions.times import parse_posted_at
from chatterlake.operators import silver as S
from chatterlake.plans.export import export_layers
from chatterlake.schemas import struct_of


def bronze(spark, *payloads):
    rows = [
        (i, "sr", "cr", "reddit", f"p{i}", None,
         p if p is None or isinstance(p, str) else json.dumps(p), datetime(2024, 1, 1))
        for i, p in enumerate(payloads)
    ]
    return spark.createDataFrame(rows, struct_of("bronze_posts"))


def silver(spark, *payloads):
    return S.silver_extract(bronze(spark, *payloads)).orderBy("id").collect()


def test_missing_payload_gives_defaults(spark):
    row = silver(spark, None)[0]
    assert (row.post_text, row.posted_at, row.author_name, row.post_url) == ("", None, None, None)
    assert (row.like_count, row.view_count, row.is_retweet) == (0, 0, False)


def test_text_falls_back_to_title_and_body(spark):
    rows = silver(
        spark, {"text": "", "title": "T", "selftext": "", "description": "D"},
        {"title": "only"}, {"other": 1}, {"text": "kept ", "title": "T"},
    )
    assert [r.post_text for r in rows] == ["T D", "only", "", "kept "]


def test_author_takes_first_non_empty(spark):
    rows = silver(spark, {"author_name": "", "author": "a"}, {"uploader": "u"}, {"channel": "c",
                                                                              "uploader": "u"})
    assert [r.author_name for r in rows] == ["a", "u", "c"]


def test_zero_metric_falls_back_to_payload_field(spark):
    rows = silver(
        spark, {"public_metrics": {"like_count": 0, "impression_count": 7}, "like_count": 5,
                "view_count": 9},
        {"public_metrics": {"reply_count": 3}, "reply_count": 4, "share_count": 2},
    )
    assert (rows[0].like_count, rows[0].view_count) == (5, 7)
    assert (rows[1].reply_count, rows[1].share_count) == (3, 2)


def test_broken_json_is_flagged_not_fatal(spark):
    rows = S.silver_extract(bronze(spark, "{", {"text": "x"}), keep_extras=True).orderBy("id")
    assert [r.payload_error for r in rows.collect()] == ["payload is not valid JSON", None]


@pytest.mark.parametrize("payload, expected", [
    ({"posted_at": "2025-01-15T10:30:00Z"}, datetime(2025, 1, 15, 10, 30)),
    ({"posted_at": "2025-01-15T10:30:00+02:00"}, datetime(2025, 1, 15, 8, 30)),
    ({"posted_at": "2025-01-15T10:30:00"}, datetime(2025, 1, 15, 10, 30)),
    ({"posted_at": "", "upload_date": "20240229"}, datetime(2024, 2, 29)),
    ({"upload_date": "20240230"}, None),
    ({"created_utc": 1704067200.0}, datetime(2024, 1, 1)),
    ({"created_utc": 0, "upload_date": "20240101"}, datetime(2024, 1, 1)),
    ({"created_utc": -5}, None),
    ({"posted_at": "yesterday"}, None),
])
def test_posted_at_forms(spark, payload, expected):
    assert silver(spark, payload)[0].posted_at == expected


def test_posted_at_ignores_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.createDataFrame([("2025-01-15T10:30:00Z",), ("1704067200",)], "t string")
        got = [r.p for r in df.select(parse_posted_at(F.col("t")).alias("p")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert got == [datetime(2025, 1, 15, 10, 30), datetime(2024, 1, 1)]


def test_tags_are_unicode_and_mentions_fire_in_addresses(spark):
    df = spark.createDataFrame([("#café #数据_1 ##x me@site.org @you",)], "t string")
    row = df.select(
        X.hashtags_in(F.col("t")).alias("h"), X.mentions_in(F.col("t")).alias("m"),
        X.mentions_in(F.col("t"), strict=True).alias("s"),
    ).first()
    assert row.h == ["café", "数据_1", "x"]
    assert row.m == ["@site", "@you"]
    assert row.s == ["@you"]


def test_merge_keeps_order_and_first_spelling(spark):
    df = spark.createDataFrame([(["Data", "#AI"], ["data", "ai", "New", "NEW", "#@x", "@#x"])],
                               "own array<string>, found array<string>")
    assert S.merge_tags(df, "own", "found", "out").first().out == [
        "Data", "#AI", "New", "#@x", "@#x"
    ]


def test_first_writer_wins_across_campaigns(spark):
    rows = [(i, f"sr{i}", "cr", "twitter", "same", None, "{}", datetime(2024, 1, 3 - i))
            for i in range(3)]
    posts = spark.createDataFrame(rows, struct_of("bronze_posts"))
    assert [r.id for r in S.dedup_posts(posts).collect()] == [2]
    assert S.dedup_bronze(posts, posts.limit(1)).count() == 0


def test_dedup_writes_one_table_and_the_driver_no_marker(spark, tmp_path, monkeypatch):
    """The driver starts a process for every file that it makes on a local disk; exports keep their marker."""
    monkeypatch.setattr("chatterlake.storage.fresh_path", lambda _, name: f"{tmp_path}/work/{name}")
    rows = [(1, "p1", 5), (1, "p1", 5), (2, "p1", 9), (3, "p1", 4), (4, "p4", 1), (4, "p4", 1), (5, None, 1), (6, None, 2)]
    posts = spark.createDataFrame([(i, "x", p, t) for i, p, t in rows], "id long, platform string, platform_id string, fetched_at int")
    assert sorted(r.id for r in S.dedup_posts(posts).collect()) == [3, 4, 5, 6]
    written = list((tmp_path / "work").iterdir())
    assert len(written) == 1 and not list(written[0].glob("*_SUCCESS*"))
    export_layers({"posts": posts}, f"{tmp_path}/export", "now")
    assert (tmp_path / "export" / "now" / "posts" / "_SUCCESS").exists()
