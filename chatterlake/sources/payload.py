"""Raw post payloads: one parse of the JSON text into a superset of all platform shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Scalars are read as text because one key can be a number on one platform and a string on
# another; typing happens once, in the silver projection.
PAYLOAD_SCHEMA = """
    text string, title string, selftext string, description string,
    author_name string, author string, channel string, uploader string,
    posted_at string, created_at string, created_utc string, upload_date string,
    post_url string, url string, is_retweet string, lang string,
    like_count string, share_count string, reply_count string, view_count string,
    public_metrics struct<like_count: string, retweet_count: string, reply_count: string,
                          impression_count: string>,
    hashtags array<string>, mentions array<string>,
    _corrupt_record string
"""


def with_payload(posts: DataFrame) -> DataFrame:
    """Add column ``p``: the parsed payload, NULL when the payload is NULL.

    Text that is not JSON leaves every key NULL and lands in ``p._corrupt_record``. A key whose
    value has another shape is NULL, and the others keep theirs; that record lands there too.
    """
    return posts.withColumn("p", F.from_json("raw_payload", PAYLOAD_SCHEMA))


def read_raw_payload(posts: DataFrame) -> DataFrame:
    """Raw posts with their payload keys as text columns; missing keys stay NULL."""
    return with_payload(posts).select("id", "platform", "platform_id", "p.*").drop("_corrupt_record")
