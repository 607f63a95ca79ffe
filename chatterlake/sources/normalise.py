"""Native API items of each platform to raw post rows.

Every normaliser is a projection: one parse of the item, no shuffle. Input columns are ``item``
(JSON text of one post), ``start_date`` and ``end_date`` of the request, plus any columns to
carry along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.functions import text as X
from chatterlake.functions.times import compact_day, epoch_to_ntz, iso_utc

REDDIT_ITEM = """
    name string, id string, title string, selftext string, author string, permalink string,
    url string, subreddit string, score bigint, num_comments bigint, created_utc string
"""
YOUTUBE_ITEM = """
    id string, title string, description string, channel string, channel_id string,
    uploader string, webpage_url string, original_url string, upload_date string,
    duration bigint, view_count bigint, like_count bigint, comment_count bigint,
    tags array<string>
"""
TWEET_ITEM = """
    id string, text string, author_id string, created_at string, lang string,
    public_metrics struct<like_count: bigint, retweet_count: bigint, reply_count: bigint,
                          impression_count: bigint>
"""
# Fixed value: link prefix.
REDDIT_LINK = "https://www.reddit.com"


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _joined(title: Column, body: Column) -> Column:
    return X.strip(F.concat(_or_empty(title), F.lit(" "), _or_empty(body)))


def _parse(items: DataFrame, schema: str) -> DataFrame:
    """Add ``i``, the parsed item. Going through a generator keeps the range filters above the
    parse; pushed below a plain projection they would parse each item several times."""
    return items.select("*", F.explode_outer(F.array(F.from_json("item", schema))).alias("i"))


def _rows(parsed: DataFrame, platform: str, carried: list[str], **c: Column) -> DataFrame:
    return parsed.select(
        *carried, F.lit(platform).alias("platform"), *[v.alias(k) for k, v in c.items()]
    )


def _carried(items: DataFrame) -> list[str]:
    return [c for c in items.columns if c not in ("item", "start_date", "end_date")]


def explode_listing(pages: DataFrame, path: str = "data.children[].data") -> DataFrame:
    """API answer pages to one row per item; the page size is bounded by the API.

    ``path`` is ``data.children[].data`` for listings and ``data[]`` for plain arrays.
    """
    nested = path.startswith("data.children")
    shape = (
        "data struct<children: array<struct<data: string>>>" if nested else "data array<string>"
    )
    page = F.from_json("page", shape)
    items = F.transform(page["data"]["children"], lambda e: e["data"]) if nested else page["data"]
    keep = [c for c in pages.columns if c != "page"]
    return pages.select(*keep, F.explode_outer(items).alias("item")).filter("item IS NOT NULL")


def normalize_reddit(items: DataFrame) -> DataFrame:
    """Reddit listing entries in the request's day range; entries without a time are dropped."""
    i = F.col("i")
    posted = epoch_to_ntz(i["created_utc"])
    link = _or_empty(i["permalink"])
    metrics = F.struct(
        F.coalesce(i["score"], F.lit(0)).alias("like_count"),
        F.coalesce(i["num_comments"], F.lit(0)).alias("reply_count"),
    )
    payload = F.struct(
        _or_empty(i["name"]).alias("id"), _or_empty(i["id"]).alias("reddit_id"),
        _or_empty(i["title"]).alias("title"), _or_empty(i["selftext"]).alias("selftext"),
        _joined(i["title"], i["selftext"]).alias("text"),
        _or_empty(i["author"]).alias("author"), _or_empty(i["author"]).alias("author_name"),
        i["subreddit"].alias("subreddit"), i["created_utc"].alias("created_utc"),
        iso_utc(posted).alias("posted_at"), link.alias("permalink"), i["url"].alias("url"),
        F.when(link != "", F.concat(F.lit(REDDIT_LINK), link)).otherwise(F.lit(""))
        .alias("post_url"),
        metrics.alias("public_metrics"),
    )
    day = F.to_date(posted)
    kept = _parse(items, REDDIT_ITEM).filter(
        posted.isNotNull() & day.between(F.col("start_date"), F.col("end_date"))
    )
    return _rows(
        kept, "reddit", _carried(items),
        platform_id=F.coalesce(X.first_present(i["id"], i["name"]), F.md5("item")),
        author_handle=_or_empty(i["author"]),
        raw_payload=F.to_json(payload),
    )


def normalize_youtube(items: DataFrame) -> DataFrame:
    """Video entries uploaded in the request's range; a bad or missing day drops the entry."""
    i = F.col("i")
    day = compact_day(i["upload_date"])
    author = X.first_present(i["channel"], i["uploader"])
    link = F.coalesce(i["webpage_url"], i["original_url"], F.lit(""))
    counts = {c: F.coalesce(i[c], F.lit(0)) for c in ("like_count", "view_count", "comment_count")}
    payload = F.struct(
        i["id"].alias("id"), _or_empty(i["title"]).alias("title"),
        _or_empty(i["description"]).alias("description"),
        _joined(i["title"], i["description"]).alias("text"),
        i["channel"].alias("channel"), i["uploader"].alias("uploader"),
        author.alias("author_name"), i["upload_date"].alias("upload_date"),
        iso_utc(day.cast("timestamp_ntz")).alias("posted_at"),
        i["view_count"].alias("view_count"), i["like_count"].alias("like_count"),
        i["comment_count"].alias("comment_count"), i["tags"].alias("tags"),
        link.alias("url"), link.alias("post_url"),
        F.struct(
            counts["like_count"].alias("like_count"), counts["view_count"].alias("view_count"),
            counts["comment_count"].alias("reply_count"),
        ).alias("public_metrics"),
    )
    kept = _parse(items, YOUTUBE_ITEM).filter(
        X.present(i["id"]).isNotNull() & day.between(F.col("start_date"), F.col("end_date"))
    )
    return _rows(
        kept, "youtube", _carried(items), platform_id=i["id"], author_handle=author,
        raw_payload=F.to_json(payload),
    )


def normalize_tweets(items: DataFrame, platform: str = "twitter") -> DataFrame:
    """Tweets, and any other source that already has the common shape; nothing is dropped."""
    i = F.col("i")
    return _rows(
        _parse(items, TWEET_ITEM), platform, _carried(items),
        platform_id=i["id"], author_handle=i["author_id"], raw_payload=F.col("item"),
    )


NORMALISERS = {"reddit": normalize_reddit, "youtube": normalize_youtube}


def route_by_platform(items: DataFrame) -> DataFrame:
    """Send every item through the normaliser of its ``platform`` column.

    Items of any other platform, and those without one, take the common form. Branches filter on
    the stored column, so a table partitioned by platform is read once.
    """
    branches = [
        run(items.filter(F.col("platform") == name).drop("platform"))
        for name, run in NORMALISERS.items()
    ]
    known = F.coalesce(F.col("platform").isin(list(NORMALISERS)), F.lit(False))
    rest = items.filter(~known)
    common = normalize_tweets(rest.withColumnRenamed("platform", "_platform"))
    branches.append(common.withColumn("platform", F.col("_platform")).drop("_platform"))
    result = branches[0]
    for branch in branches[1:]:
        result = result.unionByName(branch)
    return result


def assign_lineage_ids(crawled: DataFrame, runs: DataFrame) -> DataFrame:
    """Set the saved request and run ids on crawled rows.

    A crawled row knows the request it was fetched for (``request_id``) and its ``crawl_day``; the
    run is the newest one of that request and day. A row of a day without a run stays, without a
    run id. Requests are told apart by id, since several may share a keyword.
    """
    run = runs.groupBy(
        F.col("search_request_id").alias("request_id"), F.to_date("started_at").alias("crawl_day"),
    ).agg(F.max_by("id", F.struct("started_at", "id")).alias("crawl_run_id"))
    bare = crawled.drop("search_request_id", "crawl_run_id")
    return bare.join(run, ["request_id", "crawl_day"], "left").withColumnRenamed(
        "request_id", "search_request_id")
