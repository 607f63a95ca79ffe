"""Mergeable parts of the daily and summary tables.

One part holds the counts, sums and item counts of a campaign, platform and day. Parts add up, so the
figures of a longer time or of a whole campaign come from its parts and no post is read again.
Confidence is kept as an exact decimal sum with its count, never as an average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.functions import numbers as N
from chatterlake.operators import gold as G

#: ``date`` is NULL in the part of undated posts, which count in the summary only.
KEYS = G.DAILY_KEYS
SUMS = ["total_posts", "positive_count", "negative_count", "neutral_count", "confidence_sum", "confidence_count",
        "total_likes", "total_shares", "total_replies", "total_views"]


def with_date(gold: DataFrame) -> DataFrame:
    return gold.withColumn("date", F.to_date("posted_at"))


def day_parts(gold: DataFrame) -> DataFrame:
    """Sums and counts per campaign, platform and day."""
    confidence = F.col("sentiment_confidence")
    return with_date(gold).groupBy(*KEYS).agg(
        *[m for m in G.measures() if "avg_confidence" not in str(m)],
        F.coalesce(F.sum(confidence.cast("decimal(18,6)")), F.lit(0)).cast("decimal(38,6)").alias("confidence_sum"),
        F.count(confidence).alias("confidence_count"),
    )


def item_parts(gold: DataFrame) -> DataFrame:
    """Item counts per campaign, platform and day."""
    return G.tag_counts(with_date(gold), KEYS)


def _measures() -> list[Column]:
    average = N.ratio(F.sum("confidence_sum").cast("double"), F.sum("confidence_count"), 4)
    return [
        F.max("keyword").alias("keyword"), *[F.sum(c).alias(c) for c in SUMS if not c.startswith("confidence")],
        average.alias("avg_confidence"), F.max("ai_version").alias("ai_version"),
    ]


def _items(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys, "kind", "item").agg(F.sum("count").alias("count"))


def daily_of(parts: DataFrame, items: DataFrame, n: int = 5, at: Column | None = None) -> DataFrame:
    """The daily table, equal to :func:`chatterlake.operators.gold.campaign_daily` over the posts."""
    lists = G.lists_of(_items(items.filter("date IS NOT NULL"), KEYS), KEYS, n)
    return G.daily_rows(parts.filter("date IS NOT NULL").groupBy(*KEYS).agg(*_measures()), lists, at)


def summary_of(
    parts: DataFrame, items: DataFrame, requests: DataFrame, n: int = 5, at: Column | None = None
) -> DataFrame:
    """The summary table, equal to :func:`chatterlake.operators.gold.campaign_summary` over the posts."""
    key = ["search_request_id"]
    base = parts.groupBy(*key).agg(
        *_measures(), F.array_sort(F.collect_set("platform")).alias("platforms")).drop("keyword")
    return G.summary_rows(base, G.lists_of(_items(items, key), key, n), requests, at)
