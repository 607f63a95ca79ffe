"""Silver to gold: the searchable post table, daily and per-campaign aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.functions import numbers as N
from chatterlake.functions import text as X
from chatterlake.functions.times import to_utc

DAILY_KEYS = ["search_request_id", "platform", "date"]


def _empty() -> Column:
    return F.array().cast("array<string>")


# --- enrichment versions -------------------------------------------------------------------


def latest_enrichment(enrichment: DataFrame) -> DataFrame:
    """Newest enrichment of every post."""
    newest = Window.partitionBy("silver_post_id").orderBy(F.desc("ai_version"))
    return (
        enrichment.withColumn("_rank", F.row_number().over(newest))
        .filter("_rank = 1").drop("_rank")
    )


def enrichment_at(enrichment: DataFrame, version: int | str) -> DataFrame:
    """Enrichment at a fixed version, or at each post's ``latest``."""
    if version == "latest":
        return latest_enrichment(enrichment)
    return enrichment.filter(F.col("ai_version") == version)


# --- gold posts ----------------------------------------------------------------------------


def null_defaults() -> list[Column]:
    """Columns of an absent enrichment: empty lists and version 1."""
    return [
        F.coalesce("hashtags", _empty()).alias("hashtags"),
        F.coalesce("mentions", _empty()).alias("mentions"),
        F.coalesce("ai_version", F.lit(1)).alias("ai_version"),
    ]


def _gold_columns() -> list[Column | str]:
    hashtags, mentions, version = null_defaults()
    return [
        "id", "search_request_id", "keyword", "platform", "author_handle", "author_name",
        "post_text", "posted_at", "post_url", "sentiment", "sentiment_confidence",
        "topic_label", "topic_confidence", "language", hashtags, mentions,
        "like_count", "share_count", "reply_count", "view_count", version,
        F.col("created_at"),
    ]


def _enrichment_side(enrichment: DataFrame) -> DataFrame:
    return enrichment.select(
        F.col("silver_post_id").alias("id"), "sentiment", "sentiment_confidence", "topic_label",
        "topic_confidence", "language", "hashtags", "mentions", "ai_version",
    )


def silver_with_keyword(silver: DataFrame, requests: DataFrame) -> DataFrame:
    """Attach the campaign keyword. The request table decides by its size how it is joined."""
    keyword = requests.select(F.col("id").alias("search_request_id"), "keyword")
    return silver.join(keyword, "search_request_id", "left")


def gold_post_search(
    silver: DataFrame, enrichment: DataFrame, requests: DataFrame, ai_version: int | str = 1
) -> DataFrame:
    """Posts with their enrichment at one version; posts without one keep defaults.

    The id is the silver id, so a rebuild overwrites instead of duplicating.
    """
    side = _enrichment_side(enrichment_at(enrichment, ai_version))
    joined = silver_with_keyword(silver, requests).join(side, "id", "left")
    return joined.select(*_gold_columns())


def gold_post_search_all_versions(
    silver: DataFrame, enrichment: DataFrame, requests: DataFrame, existing: DataFrame,
    read: Callable[[DataFrame], DataFrame] = lambda posts: posts,
) -> DataFrame:
    """Script variant: one row per enrichment version, minus rows gold already holds.

    Rows are compared on five columns with plain equality, so a NULL never matches. All of them are the
    silver post's, so posts are compared, not versions, and texts by their SHA-256: what moves is
    narrow, and the ids found are taken out where the posts lie. Where posts hold references for
    texts, ``read`` puts the texts there; the result holds references again.
    """
    key = ["search_request_id", "platform", "posted_at", "author_handle"]
    text = F.sha2(F.col("post_text").cast("binary"), 256).alias("text_sha256")
    stored = read(existing).select(*key, text).distinct()
    held = read(silver).select(F.col("id").alias("_held"), *key, text).join(
        stored, [*key, "text_sha256"], "left_semi").select("_held")
    fresh = silver.join(held, F.col("id") == F.col("_held"), "left_anti")
    return silver_with_keyword(fresh, requests).join(
        _enrichment_side(enrichment), "id", "left").select(*_gold_columns())


def enrichment_bridge(
    enrichment: DataFrame, stored_silver: DataFrame, view_silver: DataFrame
) -> DataFrame:
    """Re-key enrichment from stored silver ids to view silver ids through the bronze id."""
    stored = stored_silver.select(F.col("id").alias("stored_id"), "bronze_post_id")
    view = view_silver.select(F.col("id").alias("view_id"), "bronze_post_id")
    bridge = stored.join(view, "bronze_post_id").select("stored_id", "view_id")
    return (
        enrichment.join(bridge, enrichment["silver_post_id"] == bridge["stored_id"])
        .drop("silver_post_id", "stored_id").withColumnRenamed("view_id", "silver_post_id")
    )


def gold_post_search_view(silver_view: DataFrame, enrichment: DataFrame) -> DataFrame:
    """View variant: silver already carries the keyword; every version fans out."""
    return silver_view.join(_enrichment_side(enrichment), "id", "left").select(*_gold_columns())


# --- lineage -------------------------------------------------------------------------------


def latest_completed_job(jobs: DataFrame, silver: DataFrame) -> DataFrame:
    """Newest completed enrichment job of every campaign."""
    done = jobs.filter("status = 'completed'").select(
        F.col("id").alias("job_id"), "silver_post_id", "completed_at"
    )
    owner = silver.select(F.col("id").alias("silver_post_id"), "search_request_id")
    newest = F.max(F.struct("completed_at", "job_id"))["job_id"]
    return (
        done.join(owner, "silver_post_id").groupBy("search_request_id")
        .agg(newest.alias("enrichment_job_id"))
    )


def latest_completed_run(runs: DataFrame) -> DataFrame:
    """Newest completed crawl run of every campaign."""
    newest = F.max(F.struct("completed_at", "id"))["id"]
    return (
        runs.filter("status = 'completed'").groupBy("search_request_id")
        .agg(newest.alias("source_crawl_run_id"))
    )


def stamp_lineage(gold: DataFrame, runs: DataFrame, jobs: DataFrame, at: Column) -> DataFrame:
    """Add run id, job id and build time to gold rows of any table."""
    lineage = runs.join(jobs, "search_request_id", "full_outer")
    return gold.join(lineage, "search_request_id", "left").withColumn("lineage_updated_at", at)


# --- aggregates ----------------------------------------------------------------------------


def measures(missing_confidence: str = "skip") -> list[Column]:
    """Counts, sums and average confidence of a group of gold posts.

    ``missing_confidence='zero'`` counts a missing confidence as 0, as the SQL scripts do.
    """
    conf = F.col("sentiment_confidence")
    if missing_confidence == "zero":
        conf = F.coalesce(conf, F.lit(0.0))
    return [
        F.max("keyword").alias("keyword"),
        F.count(F.lit(1)).alias("total_posts"),
        F.count_if(F.col("sentiment") == "positive").alias("positive_count"),
        F.count_if(F.col("sentiment") == "negative").alias("negative_count"),
        F.count_if(F.col("sentiment") == "neutral").alias("neutral_count"),
        N.rounded_avg(conf, 4).alias("avg_confidence"),
        F.sum("like_count").alias("total_likes"),
        F.sum("share_count").alias("total_shares"),
        F.sum("reply_count").alias("total_replies"),
        F.sum("view_count").alias("total_views"),
        F.max("ai_version").alias("ai_version"),
    ]


def tag_items(gold: DataFrame, keys: list[str]) -> DataFrame:
    """Long form of hashtags and non-empty topics: (keys, kind, item)."""
    def entry(kind: str, item: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), item.alias("item"))

    topic = F.col("topic_label")
    topics = F.when(X.present(topic).isNotNull(), F.array(entry("topic", topic)))
    entries = F.concat(
        F.transform(F.coalesce("hashtags", _empty()), lambda t: entry("hashtag", t)),
        F.coalesce(topics, F.array().cast("array<struct<kind: string, item: string>>")),
    )
    return gold.select(*keys, F.inline(entries))


def tag_counts(gold: DataFrame, keys: list[str]) -> DataFrame:
    """How often each item occurs per group. Repeats are kept as a count, never as a list."""
    return tag_items(gold, keys).groupBy(*keys, "kind", "item").agg(
        F.count(F.lit(1)).alias("count")
    )


def rank_items(counts: DataFrame, keys: list[str], n: int) -> DataFrame:
    """The ``n`` most frequent items per group and kind; ties go to the smaller item.

    Counts are complete before they are ranked, and the rank filter becomes a per-task limit.
    """
    order = Window.partitionBy(*keys, "kind").orderBy(F.desc("count"), "item")
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def top_lists(gold: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """``top_hashtags`` and ``top_topics`` per group, at most ``n`` entries each."""
    return lists_of(tag_counts(gold, keys), keys, n)


def lists_of(counts: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """Top lists per group from complete item counts."""
    def as_list(kind: str) -> Column:
        ranked = F.array_sort(
            F.collect_list(F.when(F.col("kind") == kind, F.struct("rank", "item")))
        )
        return F.transform(ranked, lambda e: e["item"])

    ranked = rank_items(counts, keys, n)
    return ranked.groupBy(*keys).agg(
        as_list("hashtag").alias("top_hashtags"), as_list("topic").alias("top_topics")
    )


def whole_lists(counts: DataFrame, keys: list[str]) -> DataFrame:
    """All items per group from complete item counts, each as often as it occurs, in order."""
    def as_list(kind: str) -> Column:
        found = F.array_sort(
            F.collect_list(F.when(F.col("kind") == kind, F.struct("item", F.col("count").cast("int").alias("count"))))
        )
        return F.flatten(F.transform(found, lambda e: F.array_repeat(e["item"], e["count"])))

    return counts.groupBy(*keys).agg(
        as_list("hashtag").alias("top_hashtags"), as_list("topic").alias("top_topics")
    )


def with_day(gold: DataFrame) -> DataFrame:
    """Add ``date``; posts without a time belong to no day and are left out."""
    return gold.filter("posted_at IS NOT NULL").withColumn("date", F.to_date("posted_at"))


def _now() -> Column:
    return to_utc(F.current_timestamp())


def campaign_daily(gold: DataFrame, n: int = 5, at: Column | None = None) -> DataFrame:
    """One row per campaign, platform and day. The post text never enters a shuffle.

    ``at`` is the build time stored as ``created_at``, the present by default.
    """
    dated = with_day(gold)
    base = dated.groupBy(*DAILY_KEYS).agg(*measures())
    return daily_rows(base, top_lists(dated, DAILY_KEYS, n), at)


def daily_rows(base: DataFrame, lists: DataFrame, at: Column | None = None) -> DataFrame:
    """Daily table from the measures and the top lists of its groups."""
    return _with_lists(base, lists, DAILY_KEYS).select(
        "search_request_id", "keyword", "platform", "date", "total_posts", "positive_count",
        "negative_count", "neutral_count", "avg_confidence", "top_hashtags", "top_topics",
        "total_likes", "total_shares", "total_replies", "total_views", "ai_version",
        (_now() if at is None else at).alias("created_at"),
    )


def _with_lists(base: DataFrame, lists: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(lists, keys, "left").withColumns(
        {c: F.coalesce(c, _empty()) for c in ("top_hashtags", "top_topics")}
    )


def platforms_of_campaign(gold: DataFrame) -> DataFrame:
    """Sorted distinct platforms per campaign."""
    return gold.groupBy("search_request_id").agg(
        F.array_sort(F.collect_set("platform")).alias("platforms")
    )


def campaign_summary(
    gold: DataFrame, requests: DataFrame, n: int = 5, at: Column | None = None
) -> DataFrame:
    """One row per request, also for campaigns without posts, whose percentages are NULL.

    Dates come from the request; ``at`` is the build time, the present by default.
    """
    key = ["search_request_id"]
    base = gold.groupBy(*key).agg(
        *measures(), F.array_sort(F.collect_set("platform")).alias("platforms")
    ).drop("keyword")
    return summary_rows(base, top_lists(gold, key, n), requests, at)


def summary_rows(
    base: DataFrame, lists: DataFrame, requests: DataFrame, at: Column | None = None
) -> DataFrame:
    """Summary table from the measures and the top lists of its campaigns."""
    key = ["search_request_id"]
    zero = F.lit(0).cast("bigint")
    owner = requests.select(
        F.col("id").alias("search_request_id"), "keyword", "start_date", "end_date"
    )
    rows = _with_lists(owner.join(base, key, "left"), lists, key)
    total = F.col("total_posts")
    counts = ["total_posts", "total_likes", "total_shares", "total_replies", "total_views"]
    percents = [
        N.percentage(F.col(f"{s}_count"), total, 2).alias(f"{s}_pct")
        for s in ("positive", "negative", "neutral")
    ]
    engagement = N.engagement(*[F.col(f"total_{m}") for m in ("likes", "shares", "replies")])
    return rows.select(
        "search_request_id", "keyword", "start_date", "end_date",
        *[F.coalesce(c, zero).alias(c) for c in counts[:1]],
        *percents, "avg_confidence",
        F.coalesce(engagement, zero).alias("total_engagement"),
        *[F.coalesce(c, zero).alias(c) for c in counts[1:]],
        "top_hashtags", "top_topics",
        F.coalesce("platforms", _empty()).alias("platforms"),
        F.coalesce("ai_version", F.lit(1)).alias("ai_version"),
        (_now() if at is None else at).alias("created_at"),
    )


def campaign_daily_sql(gold: DataFrame) -> DataFrame:
    """Script variant of the daily table: undated posts form a NULL day, missing confidence
    counts as 0, and the lists hold every hashtag and non-empty topic of the group's posts with
    repeats, in order. Only counts of items are shuffled for them; lists are made last."""
    keys = ["search_request_id", "keyword", "platform", "date"]
    dated = gold.withColumn("date", F.to_date("posted_at"))
    base = dated.groupBy(*keys).agg(*[m for m in measures("zero")[1:]], *_list_lengths())
    lists = whole_lists(tag_counts(dated, keys), keys).withColumnsRenamed({k: f"_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return base.join(lists, same, "left").select(
        *base.columns, *[F.coalesce(c, _empty()).alias(c) for c in ("top_hashtags", "top_topics")]
    )


def campaign_summary_sql(gold: DataFrame) -> DataFrame:
    """Script variant of the summary: dates are the first and last post day, missing confidence
    counts as 0. Tag lists with repeats are unbounded, so they are a table of their own
    (:func:`tag_counts` over the same keys); the row only holds their lengths."""
    total = F.col("total_posts")
    rows = gold.groupBy("search_request_id", "keyword").agg(
        F.to_date(F.min("posted_at")).alias("start_date"),
        F.to_date(F.max("posted_at")).alias("end_date"),
        *[m for m in measures("zero")[1:]], *_list_lengths(),
        F.array_sort(F.collect_set("platform")).alias("platforms"),
    )
    return rows.select(
        "search_request_id", "keyword", "start_date", "end_date", "total_posts",
        *[
            N.percentage(F.col(f"{s}_count"), total, 2).alias(f"{s}_pct")
            for s in ("positive", "negative", "neutral")
        ],
        "avg_confidence",
        N.engagement(*[F.col(f"total_{m}") for m in ("likes", "shares", "replies")])
        .alias("total_engagement"),
        "total_likes", "total_shares", "total_replies", "total_views",
        "hashtag_count", "topic_count", "platforms", "ai_version",
    )


def _list_lengths() -> list[Column]:
    return [
        F.sum(F.size(F.coalesce("hashtags", _empty()))).alias("hashtag_count"),
        F.count_if(X.present(F.col("topic_label")).isNotNull()).alias("topic_count"),
    ]


# --- replacing and rebuilding --------------------------------------------------------------


def daily_keys_to_replace(daily: DataFrame, gold: DataFrame) -> DataFrame:
    """Stored daily rows whose (campaign, platform, day) occurs among dated gold posts."""
    return daily.join(
        with_day(gold).select(*DAILY_KEYS).distinct(), DAILY_KEYS, "left_semi"
    )


def summary_keys_to_replace(summary: DataFrame, gold: DataFrame) -> DataFrame:
    """Stored summaries of campaigns that have gold posts."""
    return summary.join(
        gold.select("search_request_id").distinct(), "search_request_id", "left_semi"
    )


def replace_by_key(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Delete-then-insert: stored rows with an incoming key give way to the incoming rows."""
    kept = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.select(*existing.columns).unionByName(incoming.select(*existing.columns))


def delete_campaigns(gold: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows that stay after deleting whole campaigns; ``ids`` has ``search_request_id``."""
    return gold.join(ids.select("search_request_id"), "search_request_id", "left_anti")


def touched_campaigns(silver: DataFrame, tracking: DataFrame) -> DataFrame:
    """Campaigns to rebuild: never built, or with a silver post newer than the last build."""
    newest = silver.groupBy("search_request_id").agg(F.max("created_at").alias("newest"))
    built = tracking.select("search_request_id", "last_built_at")
    return (
        newest.join(built, "search_request_id", "left")
        .filter("last_built_at IS NULL OR newest > last_built_at")
        .select("search_request_id")
    )


def incremental_gold(
    silver: DataFrame, enrichment: DataFrame, requests: DataFrame, tracking: DataFrame,
    ai_version: int | str = 1,
) -> DataFrame:
    """Gold posts of the touched campaigns, each rebuilt as a whole.

    Written with dynamic partition overwrite this equals a full rebuild.
    """
    touched = touched_campaigns(silver, tracking)
    return gold_post_search(
        silver.join(touched, "search_request_id", "left_semi"), enrichment, requests, ai_version
    )


def record_build(tracking: DataFrame, built: DataFrame, at: Column) -> DataFrame:
    """Replace the tracking rows of built campaigns; ``built`` has the posts processed."""
    rows = built.select("search_request_id", at.alias("last_built_at"), "posts_processed")
    return replace_by_key(tracking, rows, ["search_request_id"])
