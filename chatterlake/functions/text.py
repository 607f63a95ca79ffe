"""Text, tag and label expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that count as blank, the word class used by tag
# patterns, the tag patterns and the text budgets of the two model families.
WHITESPACE = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WORD = r"[\p{L}\p{N}_]"
HASHTAG_PATTERN = f"#({WORD}+)"
MENTION_PATTERN = f"@({WORD}+)"
STRICT_MENTION_PATTERN = rf"(?<![\p{{L}}\p{{N}}_.+-])@({WORD}+)"
LOCAL_MODEL_CHARS = 512
REMOTE_MODEL_CHARS = 2000


def strip(text: Column) -> Column:
    """Remove blanks of any kind from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def present(text: Column) -> Column:
    """NULL for the empty string, so that ``coalesce`` treats it as missing."""
    return F.nullif(text, F.lit(""))


def first_present(*texts: Column) -> Column:
    return F.coalesce(*[present(t) for t in texts])


def is_blank(text: Column) -> Column:
    return F.coalesce(strip(text) == "", F.lit(True))


def hashtags_in(text: Column) -> Column:
    """Words after '#', without the sign, in reading order."""
    return F.regexp_extract_all(text, F.lit(HASHTAG_PATTERN), F.lit(1))


def mentions_in(text: Column, strict: bool = False) -> Column:
    """Words after '@', with the sign put back.

    The default also fires inside e-mail addresses; ``strict`` does not.
    """
    pattern = STRICT_MENTION_PATTERN if strict else MENTION_PATTERN
    return F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda w: F.concat(F.lit("@"), w)
    )


def tag_key(tag: Column) -> Column:
    """Comparison form of a tag: lower case, leading '@'s then '#'s removed."""
    return F.regexp_replace(F.lower(tag), "^@*#*", "")


def estimate_tokens(text: Column) -> Column:
    """About four characters per token; at least one for non-empty text."""
    n = F.length(F.coalesce(text, F.lit(""))).cast("bigint")
    return F.when(n == 0, F.lit(0).cast("bigint")).otherwise(
        F.greatest(F.lit(1).cast("bigint"), F.floor(n / 4))
    )


def keyword_slug(keyword: Column) -> Column:
    return F.lower(F.regexp_replace(keyword, "[^a-zA-Z0-9]", ""))


def model_version(model_name: Column) -> Column:
    return F.substring_index(model_name, "/", -1)


def truncate(text: Column, limit: int = LOCAL_MODEL_CHARS) -> Column:
    """The leading part of a text that a length-limited model accepts."""
    return F.substring(text, 1, limit)


def request_key(keyword: Column, platform: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(":", keyword, platform, start.cast("string"), end.cast("string"))


def surrogate_key(*parts: Column) -> Column:
    """md5 over the parts; NULL as soon as one part is NULL."""
    return F.md5(F.concat(*[p.cast("string") for p in parts]))


def campaign_label(keyword: Column, platform: Column) -> Column:
    return F.concat(keyword, F.lit(" ("), platform, F.lit(")"))


def platforms_label(platforms: Column) -> Column:
    joined = F.array_join(platforms, ", ")
    return F.coalesce(present(joined), F.lit("unknown"))


# Display names of request states.
STATUS_LABELS = {
    "completed": "Completed",
    "running": "Running",
    "pending": "Pending",
    "failed": "Failed",
}


def status_label(status: Column) -> Column:
    chain = F
    for value, label in STATUS_LABELS.items():
        chain = chain.when(status == value, F.lit(label))
    return chain.otherwise(F.lit("Unknown"))
