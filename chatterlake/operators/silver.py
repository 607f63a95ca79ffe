"""Bronze to silver: typed posts, tags and first-writer-wins deduplication."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake import storage
from chatterlake.functions import numbers as N
from chatterlake.functions import text as X
from chatterlake.functions.times import parse_posted_at
from chatterlake.sources.payload import with_payload

POST_KEY = ["platform", "platform_id"]


def author_name(p: Column) -> Column:
    return X.first_present(p["author_name"], p["author"], p["channel"], p["uploader"])


def post_text(p: Column) -> Column:
    """``text`` when present, else title and body joined; '' when there is neither."""
    body = X.first_present(p["selftext"], p["description"])
    joined = F.concat(
        F.coalesce(p["title"], F.lit("")), F.lit(" "), F.coalesce(body, F.lit(""))
    )
    return F.coalesce(X.present(p["text"]), X.strip(joined), F.lit(""))


def posted_at(p: Column) -> Column:
    """First usable time key. Numeric zero counts as missing, as '' and NULL do."""
    keys = ["posted_at", "created_at", "created_utc", "upload_date"]
    usable = [F.when(~p[k].rlike(r"^(|-?0(\.0+)?)$"), p[k]) for k in keys]
    return parse_posted_at(F.coalesce(*usable))


def engagement_counts(p: Column) -> dict[str, Column]:
    """Platform metric, else payload field, else 0; zero counts as missing."""
    m = p["public_metrics"]
    pairs = {
        "like_count": ("like_count", "like_count"),
        "share_count": ("retweet_count", "share_count"),
        "reply_count": ("reply_count", "reply_count"),
        "view_count": ("impression_count", "view_count"),
    }
    return {
        name: N.first_nonzero(N.whole_number(m[metric]), N.whole_number(p[field]))
        for name, (metric, field) in pairs.items()
    }


def post_url(p: Column) -> Column:
    return X.first_present(p["post_url"], p["url"])


def is_retweet(p: Column) -> Column:
    return F.coalesce(p["is_retweet"].try_cast("boolean"), F.lit(False))


def payload_error(p: Column) -> Column:
    return F.when(p["_corrupt_record"].isNotNull() & F.try_parse_json("raw_payload").isNull(),
                  F.lit("payload is not valid JSON"))


def silver_extract(bronze: DataFrame, keep_extras: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """Typed silver rows. One JSON parse per post, no shuffle.

    Ids are the bronze ids, so a rerun gives the same rows. ``keep_extras`` also returns the
    payload's own tag lists and a payload error, which the enrichment step needs; ``keep`` names
    further columns that stay.
    """
    p = F.col("p")
    extras = [
        F.coalesce(p[c], F.array().cast("array<string>")).alias(f"payload_{c}")
        for c in ("hashtags", "mentions")
    ]
    extras.append(payload_error(p).alias("payload_error"))
    return with_payload(bronze).select(
        "id", F.col("id").alias("bronze_post_id"), "search_request_id", "platform",
        "platform_id", "author_handle",
        author_name(p).alias("author_name"),
        post_text(p).alias("post_text"),
        posted_at(p).alias("posted_at"),
        *[c.alias(n) for n, c in engagement_counts(p).items()],
        post_url(p).alias("post_url"),
        is_retweet(p).alias("is_retweet"),
        F.col("fetched_at").alias("created_at"),
        *(extras if keep_extras else []),
        *keep,
    )


def merge_tags(df: DataFrame, own: str, found: str, out: str) -> DataFrame:
    """Append the tags found in the text to the payload's own list, without repeats.

    The first spelling wins and the order is kept. Each row is handled on its own.
    """
    tags, keys = f"_{out}_tags", f"_{out}_keys"
    return (
        df.withColumn(tags, F.filter(F.concat(own, found), lambda t: t.isNotNull()))
        .withColumn(keys, F.transform(tags, X.tag_key))
        .withColumn(
            out,
            F.filter(
                tags,
                lambda t, i: F.array_position(F.col(keys), F.get(F.col(keys), i)) == i + 1,
            ),
        )
        .drop(tags, keys)
    )


def with_tags(silver: DataFrame, strict_mentions: bool = False) -> DataFrame:
    """Hashtags and mentions of payload and text; needs ``silver_extract(keep_extras=True)``."""
    found = silver.withColumn("_h", X.hashtags_in(F.col("post_text"))).withColumn(
        "_m", X.mentions_in(F.col("post_text"), strict_mentions)
    )
    merged = merge_tags(found, "payload_hashtags", "_h", "hashtags")
    merged = merge_tags(merged, "payload_mentions", "_m", "mentions")
    return merged.drop("_h", "_m", "payload_hashtags", "payload_mentions")


def _first_only(incoming: DataFrame, key: list[str], first_by: list[str], row: str) -> DataFrame:
    """Drop all but the first row of each key; ``row`` names a row.

    Only keys, order and row names are ranked. The names of the later rows and of those that repeat are
    written, in one table, so Spark knows how few they are before it decides how to drop them, and rows
    with their texts need not move. A key with a NULL part equals no other key, so such rows all stay. Of
    rows that repeat a name, as a batch sent twice does, one stays; only those are shuffled for it.
    """
    order = Window.partitionBy(*key).orderBy(*first_by, row)
    narrow = incoming.select(*dict.fromkeys([*key, *first_by, row])).dropna(subset=key)
    behind = narrow.withColumn("_first", F.first(row).over(order)).filter(F.col(row) != F.col("_first"))
    repeated = narrow.groupBy(row).count().filter("count > 1")
    named = storage.write_table(
        behind.select(F.col(row).alias("_name"), F.lit(False).alias("_repeats")).unionByName(
            repeated.select(F.col(row).alias("_name"), F.lit(True).alias("_repeats"))),
        storage.fresh_path(incoming.sparkSession, "named-rows"))
    later = named.filter("NOT _repeats").select(F.col("_name").alias("_later"))
    twice = named.filter("_repeats").select(F.col("_name").alias("_twice"))
    kept = incoming.join(later, F.col(row) == F.col("_later"), "left_anti")
    if twice.isEmpty():
        return kept
    same = F.col(row) == F.col("_twice")
    return kept.join(twice, same, "left_anti").unionByName(
        kept.join(twice, same, "left_semi").dropDuplicates([row])
    )


def dedup_posts(incoming: DataFrame) -> DataFrame:
    """Keep the first arrival of each (platform, platform_id). Post ids name rows."""
    return _first_only(incoming, POST_KEY, ["fetched_at", "id"], "id")


def dedup_bronze(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows an insert-or-ignore would add: new keys only, first writer wins."""
    return append_new(incoming, existing, POST_KEY, ["fetched_at", "id"])


def append_new(
    incoming: DataFrame, existing: DataFrame, key: list[str], first_by: list[str]
) -> DataFrame:
    """Rows whose key is not stored yet; of repeats inside the batch the first one counts."""
    fresh = incoming.join(existing.select(*key), key, "left_anti")
    if "id" in incoming.columns and "id" not in key:
        return _first_only(fresh, key, first_by, "id")
    return fresh.dropDuplicates(key) if set(first_by) <= set(key) else _ranked(fresh, key, first_by)


def _ranked(rows: DataFrame, key: list[str], first_by: list[str]) -> DataFrame:
    first = Window.partitionBy(*key).orderBy(*first_by)
    return rows.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")


def unenriched_posts(
    bronze: DataFrame, silver: DataFrame, limit: int | None = None
) -> DataFrame:
    """Bronze posts without a silver row.

    With a limit, the oldest ones: ids are picked on narrow columns first and the payload is
    fetched only for those.
    """
    known = silver.select(F.col("bronze_post_id").alias("id"))
    if limit is None:
        return bronze.join(known, "id", "left_anti")
    picked = (
        bronze.select("id", "fetched_at").join(known, "id", "left_anti")
        .orderBy("fetched_at", "id").limit(limit)
    )
    return bronze.join(picked.select("id"), "id", "left_semi").orderBy("fetched_at", "id")


def posts_needing_enrichment(
    silver: DataFrame, enrichment: DataFrame, jobs: DataFrame
) -> DataFrame:
    """Silver posts without enrichment, unless their job used up its attempts."""
    spent = jobs.filter("status = 'failed' AND attempts >= max_attempts").select(
        F.col("silver_post_id").alias("id")
    )
    done = enrichment.select(F.col("silver_post_id").alias("id"))
    return silver.join(done, "id", "left_anti").join(spent, "id", "left_anti")


def bronze_to_silver_new(
    bronze: DataFrame, silver: DataFrame, read: Callable[[DataFrame], DataFrame] = lambda posts: posts
) -> DataFrame:
    """Silver rows for the bronze posts that have none yet.

    Where bronze posts hold references for payloads, ``read`` puts the payloads there, once the posts
    are picked, so no payload is shuffled.
    """
    return silver_extract(read(unenriched_posts(bronze, silver)))
