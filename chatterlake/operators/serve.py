"""Reads over the gold tables: filters, search, pages, rankings and read models."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.functions import numbers as N
from chatterlake.functions import text as X
from chatterlake.functions.times import ntz
from chatterlake.operators import search_index
from chatterlake.operators.gold import rank_items, tag_counts
from chatterlake.storage import write_table

Moment = str | date | datetime


def newest_first(time: str = "posted_at", tie: str = "id") -> list[Column]:
    """Sort order of every post list; the id makes pages stable."""
    return [F.desc_nulls_last(time), F.col(tie)]


def page_bounds(total: Column, page: Column, size: int) -> dict[str, Column]:
    """Number of pages (at least 1) and the offset of a page."""
    pages = F.greatest(F.lit(1), F.ceil(total / F.lit(size)))
    return {"pages": pages.cast("bigint"), "row_offset": ((page - 1) * size).cast("bigint")}


def take_page(ordered: DataFrame, limit: int | None, offset: int = 0) -> DataFrame:
    if limit is None:
        return ordered.offset(offset) if offset else ordered
    return ordered.offset(offset).limit(limit)


# --- filters -------------------------------------------------------------------------------


def filter_posts(
    gold: DataFrame, keyword: str, sentiment: str | None = None, platform: str | None = None,
    language: str | None = None, date_from: Moment | None = None, date_to: Moment | None = None,
    limit: int | None = None, offset: int = 0, requests: DataFrame | None = None,
) -> DataFrame:
    """Posts of one keyword in the half-open range [from, to), newest first.

    With the table of ``requests`` the keyword becomes campaign ids first, by which the gold table
    is partitioned, so only their partitions are read.
    """
    hits = gold.filter(F.col("keyword") == keyword)
    if requests is not None:
        ids = requests.filter(F.col("keyword") == keyword).select(
            F.col("id").alias("search_request_id"))
        hits = hits.join(ids, "search_request_id", "left_semi")
    for column, wanted in [("sentiment", sentiment), ("platform", platform),
                           ("language", language)]:
        if wanted is not None:
            hits = hits.filter(F.col(column) == wanted)
    if date_from is not None:
        hits = hits.filter(F.col("posted_at") >= ntz(date_from))
    if date_to is not None:
        hits = hits.filter(F.col("posted_at") < ntz(date_to))
    return take_page(hits.orderBy(*newest_first()), limit, offset)


def matching_posts(
    gold: DataFrame, keyword: str | None = None, sentiment: str | None = None,
    platform: str | None = None, start: Moment | None = None, end: Moment | None = None,
    index: DataFrame | None = None,
) -> DataFrame:
    """Posts whose text contains the keyword (any case; % and _ act as wildcards).

    The date range is closed and applies only when both ends are given. With an ``index`` of
    :mod:`chatterlake.operators.search_index` over the gold table, files that cannot match are not read.
    """
    hits = gold
    if keyword and index is not None:
        hits = search_index.narrowed(hits, index, keyword)
    if keyword:
        hits = hits.filter(F.col("post_text").ilike(f"%{keyword}%"))
    if sentiment:
        hits = hits.filter(F.col("sentiment") == sentiment)
    if platform:
        hits = hits.filter(F.col("platform") == platform)
    if start and end:
        hits = hits.filter(F.col("posted_at").between(ntz(start), ntz(end)))
    return hits


class Page(NamedTuple):
    rows: DataFrame
    total: DataFrame


def search_posts(
    gold: DataFrame, limit: int | None = None, offset: int = 0, work: str | None = None,
    read: Callable[[DataFrame], DataFrame] = lambda posts: posts,
    read_page: Callable[[DataFrame], DataFrame] | None = None, **filters
) -> Page:
    """One page of :func:`matching_posts`, newest first, and the total number of matches.

    With a folder ``work`` the texts are searched once: ids and times of the matches are written there,
    counted and paged, and only the campaigns on the page are read again. Where posts hold references for
    texts, ``read`` puts the texts there; ``read_page`` does so for the page, which is written to ``work`` first.
    """
    hits = matching_posts(read(gold), **filters)
    if work is None:
        total = hits.agg(F.count(F.lit(1)).alias("total"))
        return Page(take_page(hits.orderBy(*newest_first()), limit, offset), total)
    found = write_table(hits.select("search_request_id", "id", "posted_at"), f"{work}/found")
    page = take_page(found.orderBy(*newest_first()), limit, offset)
    rows = gold.join(page.select("search_request_id", "id"), ["search_request_id", "id"], "left_semi")
    rows = read_page(write_table(rows, f"{work}/page")) if read_page else read(rows)
    return Page(rows.orderBy(*newest_first()), found.agg(F.count(F.lit(1)).alias("total")))


def with_total(page: Page) -> DataFrame:
    """Page rows with the total as a column, computed once as a scalar subquery."""
    return page.rows.withColumn("total", page.total.scalar())


def post_card() -> list[Column]:
    """Display fields of a post with their fallbacks."""
    def text(c: str, fallback: str = "") -> Column:
        return F.coalesce(X.present(F.col(c)), F.lit(fallback))

    confidence = N.half_up(F.coalesce("sentiment_confidence", F.lit(0.0)), 2)
    zero = F.lit(0).cast("bigint")
    return [
        F.coalesce(X.first_present(F.col("author_handle"), F.col("author_name")),
                   F.lit("Unknown")).alias("author"),
        text("post_text").alias("text"), text("sentiment", "unknown").alias("sentiment"),
        confidence.alias("confidence"),
        F.coalesce(F.date_format("posted_at", "yyyy-MM-dd"), F.lit("")).alias("date"),
        *[F.coalesce(f"{one}_count", zero).alias(many)
          for one, many in [("like", "likes"), ("share", "shares"), ("reply", "replies")]],
        text("platform").alias("platform"), text("topic_label").alias("topic"),
        text("language").alias("language"),
    ]


def post_explorer(
    gold: DataFrame, limit: int | None = None, offset: int = 0, work: str | None = None, **options
) -> DataFrame:
    """Search result as cards with the real total; options and filters are those of :func:`search_posts`."""
    page = search_posts(gold, limit, offset, work, **options)
    return page.rows.select("id", *post_card()).withColumn("total", page.total.scalar())


def lookup(df: DataFrame, **key: object) -> DataFrame:
    """Rows whose columns equal the given values; reaches the scan as pushed filters."""
    for column, value in key.items():
        df = df.filter(F.col(column) == F.lit(value))
    return df


def oldest_in_state(
    df: DataFrame, status: str, limit: int | None, order: str = "created_at", **key: object
) -> DataFrame:
    """Work list: rows in a state, oldest first."""
    return take_page(lookup(df, status=status, **key).orderBy(order, "id"), limit)


def posts_since(posts: DataFrame, since: Moment) -> DataFrame:
    """Posts stored strictly after a moment."""
    return posts.filter(F.col("created_at") > ntz(since))


def newest(df: DataFrame, time: str, limit: int | None = None, tie: str = "id") -> DataFrame:
    return take_page(df.orderBy(*newest_first(time, tie)), limit)


def recent_per_campaign(posts: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest posts of every campaign; each task forwards at most ``n`` per campaign."""
    order = Window.partitionBy("search_request_id").orderBy(*newest_first())
    return posts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


# --- aggregates ----------------------------------------------------------------------------


def sentiment_breakdown(gold: DataFrame) -> DataFrame:
    """Posts per keyword and sentiment, missing sentiment as 'unknown'."""
    label = F.coalesce("sentiment", F.lit("unknown")).alias("sentiment")
    return count_by(gold, "keyword", label).orderBy("keyword", F.desc("count"), "sentiment")


def sentiment_distribution(gold: DataFrame) -> DataFrame:
    """Posts per campaign and known sentiment."""
    known = gold.filter("sentiment IS NOT NULL")
    return count_by(known, "search_request_id", "sentiment").orderBy(
        "search_request_id", F.desc("count"), "sentiment"
    )


def daily_volume(gold: DataFrame) -> DataFrame:
    """Posts per campaign and day; undated posts are left out."""
    dated = gold.filter("posted_at IS NOT NULL")
    return count_by(dated, "search_request_id", F.to_date("posted_at").alias("date")).orderBy(
        "search_request_id", "date"
    )


def count_by(df: DataFrame, *keys: Column | str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def explode_hashtags(gold: DataFrame) -> DataFrame:
    """One row per post and hashtag."""
    return gold.select("id", "search_request_id", F.explode("hashtags").alias("hashtag"))


def top_items(gold: DataFrame, kind: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent hashtags or topics of every campaign, with counts."""
    keys = ["search_request_id"]
    if kind == "topic":  # every non-NULL label counts here, the empty one included
        counts = gold.filter("topic_label IS NOT NULL").groupBy(
            *keys, F.lit("topic").alias("kind"), F.col("topic_label").alias("item")
        ).agg(F.count(F.lit(1)).alias("count"))
    else:
        counts = tag_counts(gold.withColumn("topic_label", F.lit(None).cast("string")), keys)
    return rank_items(counts, keys, n).select(*keys, F.col("item").alias(kind), "count", "rank")


def campaign_stats(gold: DataFrame) -> DataFrame:
    """Campaign figures straight from the posts, for campaigns without a summary row."""
    zero = F.lit(0).cast("bigint")
    total = F.count(F.lit(1))

    def share(label: str) -> Column:
        return N.percentage(F.count_if(F.col("sentiment") == label), total, 1)

    return gold.groupBy("search_request_id").agg(
        F.max("keyword").alias("keyword"), F.min("platform").alias("platform"),
        total.alias("total_posts"),
        *[share(s).alias(f"{s}_pct") for s in ("positive", "negative", "neutral")],
        F.coalesce(N.rounded_avg(F.col("sentiment_confidence"), 3), F.lit(0.0))
        .alias("avg_confidence"),
        *[F.coalesce(F.sum(f"{one}_count"), zero).alias(f"total_{many}")
          for one, many in [("like", "likes"), ("share", "shares"), ("reply", "replies"),
                            ("view", "views")]],
    )


def volume_trend(daily: DataFrame, keyword: str | None = None) -> DataFrame:
    """Posts per keyword and day, one row per platform day."""
    rows = daily if keyword is None else daily.filter(F.col("keyword") == keyword)
    return rows.select("keyword", "platform", "date", "total_posts").orderBy(
        "keyword", "date", "platform"
    )


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count of every table, one aggregate per table."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table_name"), "rows")
        for name, df in tables.items()
    ]
    return union_all(counts)


def union_all(parts: list[DataFrame]) -> DataFrame:
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


# --- campaigns and read models -------------------------------------------------------------

KPIS = ["total_posts", "positive_pct", "negative_pct", "neutral_pct", "avg_confidence",
        "total_likes", "total_shares", "total_replies", "total_views"]


def campaigns(gold: DataFrame) -> DataFrame:
    """Distinct (campaign, keyword, platform) with the label shown in selectors."""
    rows = gold.select("search_request_id", "keyword", "platform").distinct()
    label = X.campaign_label(F.col("keyword"), F.col("platform"))
    return rows.withColumn("label", label).orderBy("keyword", "platform", "search_request_id")


def campaign_analytics(summary: DataFrame, gold: DataFrame) -> DataFrame:
    """Figures of every campaign: the summary row when there is one, else from its posts."""
    missing = gold.join(summary.select("search_request_id"), "search_request_id", "left_anti")
    stored = summary.select(
        "search_request_id", "keyword", X.platforms_label(F.col("platforms")).alias("platform"),
        *[F.coalesce(c, F.lit(0)).alias(c) for c in KPIS],
    )
    return stored.unionByName(
        campaign_stats(missing).select("search_request_id", "keyword", "platform", *KPIS)
    )


def campaign_items(summary: DataFrame, gold: DataFrame, kind: str, n: int = 10) -> DataFrame:
    """Top hashtags or topics shown for a campaign.

    A campaign whose summary lists some shows those with count 0, any other one the counted
    top ``n`` of its posts.
    """
    listed = summary.select(
        "search_request_id", F.posexplode(f"top_{kind}s").alias("rank", kind)
    ).select("search_request_id", kind, F.lit(0).cast("bigint").alias("count"),
             (F.col("rank") + 1).alias("rank"))
    with_list = summary.filter(F.size(f"top_{kind}s") > 0).select("search_request_id")
    rest = gold.join(with_list, "search_request_id", "left_anti")
    return listed.unionByName(top_items(rest, kind, n))


def only(analytics: DataFrame, ids: list[str] | None) -> DataFrame:
    """Rows of the chosen campaigns; ids that do not exist are skipped."""
    return analytics if ids is None else analytics.filter(F.col("search_request_id").isin(ids))


def sentiment_comparison(analytics: DataFrame, ids: list[str] | None = None) -> DataFrame:
    return only(analytics, ids).select(
        "search_request_id", F.col("keyword").alias("campaign"),
        *[F.col(f"{s}_pct").alias(s) for s in ("positive", "negative", "neutral")],
    )


def engagement_comparison(analytics: DataFrame, ids: list[str] | None = None) -> DataFrame:
    return only(analytics, ids).select(
        "search_request_id", F.col("keyword").alias("campaign"),
        *[F.col(f"total_{m}").alias(m) for m in ("likes", "shares", "replies", "views")],
    )


def volume_comparison(
    analytics: DataFrame, gold: DataFrame, ids: list[str] | None = None
) -> DataFrame:
    """Daily volume of the chosen campaigns; the posts are filtered before they are counted."""
    names = only(analytics, ids).select("search_request_id", F.col("keyword").alias("campaign"))
    return daily_volume(only(gold, ids)).join(names, "search_request_id").select(
        "search_request_id", "campaign", "date", "count"
    )


def comparison_table(analytics: DataFrame, ids: list[str] | None = None) -> DataFrame:
    return only(analytics, ids).select(
        "search_request_id", F.col("keyword").alias("campaign"), "platform", "total_posts", "positive_pct",
        "negative_pct", "neutral_pct",
        N.half_up(F.col("avg_confidence"), 3).alias("avg_confidence"),
        *[F.col(f"total_{m}").alias(m) for m in ("likes", "shares", "replies", "views")],
    )


def melt_metrics(wide: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Wide to long: (keys, metric, value)."""
    return wide.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(
        keys, metrics, "metric", "value"
    )
