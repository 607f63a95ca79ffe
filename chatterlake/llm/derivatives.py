"""Derivative WARC records: linked metadata and plain-text conversions of responses.

Each response yields a ``metadata`` record (title, language, digest, source headers, links) and a
``conversion`` record (its plain text). Both refer to the response by its record id and keep its
target and date. Everything is a function of the row: nothing is shuffled, and records of
one host or one page never meet in a task. Digests are labelled SHA-256 values in hexadecimal.
"""

from __future__ import annotations

import html as references

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CRLF = "\r\n"
#: Capture time of pages that carry none.
DATE = "1970-01-01T00:00:00Z"

# What separates blocks of text, and what is no text.
_HIDDEN = ("(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>"
           "|<noscript\\b.*?</noscript\\s*>|<template\\b.*?</template\\s*>")
_BLOCK = ("(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h[1-6]|head|header|hr"
          "|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)\\b[^>]*>")
_TAG = "</?[A-Za-z!][^>]*>"
# References that the SQL form decodes; the operator decodes all.
_ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "©"),
             ("&middot;", "·")]
_TITLE = "(?is)<title[^>]*>(.*?)</title>"
_LANG = "(?is)<html[^>]*\\blang=\"([^\"]*)\""
_LINK = "(?i)href=\"([^\"]*)\""


def _digest(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def _record_id(*parts: Column) -> Column:
    """An identifier that depends on the parts alone, so a repeated run gives the same records."""
    shown = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(
        shown, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _decoded(text: Column) -> Column:
    """All named and numeric character references as HTML 5 reads them; a non-breaking space as a space."""
    @F.arrow_udf("string")
    def decode(texts):
        import pyarrow as pa

        return pa.array([None if t is None else references.unescape(t).replace("\xa0", " ")
                         for t in texts.to_pylist()], pa.string())

    return decode(text)


def plain_text(html: Column) -> Column:
    """Text of a page: hidden parts and tags removed, blocks on lines of their own, references decoded."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), _HIDDEN, "")
    text = F.regexp_replace(text, _BLOCK, "\n")
    text = _decoded(F.regexp_replace(text, _TAG, ""))
    text = F.regexp_replace(text, "[ \\t\\r\\f]+", " ")
    return F.btrim(F.regexp_replace(text, " ?\\n[ \\n]*", "\n"), F.lit(" \n"))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Response records of stored pages (page_id, url, html).

    A null page is an empty payload; a null url stays null. The header block is the one of a
    successful HTML answer of that length.
    """
    payload = F.coalesce("html", F.lit(""))
    headers = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.octet_length(payload).cast("string"))
    return pages.select(
        "page_id", F.lit("response").alias("warc_type"),
        _record_id(F.lit("response"), F.col("page_id"), F.col("url"), F.md5(payload.cast("binary"))).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit(date).alias("warc_date"), headers.alias("http_headers"),
        payload.alias("payload"), _digest(payload).alias("payload_digest"))


def derive(source: DataFrame) -> DataFrame:
    """Two records per response, in the columns of a WARC header and its block.

    ``source`` has page_id, record_id, target_uri, warc_date, http_headers, payload and
    payload_digest; its other columns are ignored. Responses that repeat give records that repeat,
    with the same ids. An empty payload has an empty conversion; an empty table gives no records.    """
    payload = F.col("payload")
    title = F.btrim(F.regexp_replace(F.regexp_extract(payload, _TITLE, 1), "\\s+", " "), F.lit(" "))
    links = F.regexp_extract_all(payload, F.lit(_LINK), F.lit(1))
    listed = F.when(F.size(links) > 0, F.concat(F.lit("outlink: "), F.array_join(links, f"{CRLF}outlink: "), F.lit(CRLF))
                    ).otherwise(F.lit(""))
    described = F.concat(
        F.lit("title: "), title, F.lit(f"{CRLF}lang: "), F.regexp_extract(payload, _LANG, 1),
        F.lit(f"{CRLF}source-digest: "), F.col("payload_digest"),
        F.lit(f"{CRLF}source-header: "), F.replace("http_headers", F.lit(CRLF), F.lit(f"{CRLF}source-header: ")),
        F.lit(CRLF), listed)
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.lit("application/warc-fields").alias("content_type"),
                 described.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.lit("text/plain; charset=utf-8").alias("content_type"),
                 plain_text(payload).alias("block")))
    made = source.select("page_id", "record_id", "target_uri", "warc_date", "payload_digest",
                         F.explode(kinds).alias("r"))
    return made.select(
        "page_id", "r.warc_type", _record_id(F.col("r.warc_type"), F.col("record_id")).alias("record_id"),
        F.col("record_id").alias("refers_to"), "target_uri", "warc_date", "r.content_type",
        F.octet_length("r.block").cast("bigint").alias("content_length"), _digest(F.col("r.block")).alias("block_digest"),
        F.col("payload_digest").alias("source_digest"), "r.block")


def serialized(records: DataFrame) -> DataFrame:
    """(page_id, warc_type, record): the bytes of each record as they stand in a WARC file."""
    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)), F.lit(""))

    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("warc_type")), line("WARC-Record-ID", F.col("record_id")),
        line("WARC-Refers-To", F.col("refers_to")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("warc_date")), line("WARC-Block-Digest", F.col("block_digest")),
        line("Content-Type", F.col("content_type")), line("Content-Length", F.col("content_length")), F.lit(CRLF))
    return records.select("page_id", "warc_type",
                          F.concat(head, "block", F.lit(CRLF * 2)).cast("binary").alias("record"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_text() -> str:
    out = f"regexp_replace(payload, {_sql(_HIDDEN)}, '', 'g')"
    out = f"regexp_replace({out}, {_sql(_BLOCK)}, chr(10), 'g')"
    out = f"regexp_replace({out}, {_sql(_TAG)}, '', 'g')"
    for entity, sign in _ENTITIES:
        out = f"replace({out}, {_sql(entity)}, {_sql(sign)})"
    out = f"regexp_replace({out}, '&amp;?', '&', 'g')"
    out = f"regexp_replace({out}, '[ \\t\\r\\f]+', ' ', 'g')"
    return f"trim(regexp_replace({out}, ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"


_UUID = "'^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5'"
_BREAK = "chr(13) || chr(10)"
ORACLE = f"""
    WITH r AS (
        SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS digest,
            '<urn:uuid:' || regexp_replace(md5('response|' || coalesce(CAST(page_id AS VARCHAR), '-') || '|' ||
                coalesce(url, '-') || '|' || md5(coalesce(html, ''))), {_UUID}) || '>' AS source_id
        FROM pages),
    m AS (
        SELECT *, 'metadata' AS warc_type, 'application/warc-fields' AS content_type,
            'title: ' || trim(regexp_replace(regexp_extract(payload, {_sql(_TITLE)}, 1), '\\s+', ' ', 'g'), ' ')
            || {_BREAK} || 'lang: ' || regexp_extract(payload, {_sql(_LANG)}, 1)
            || {_BREAK} || 'source-digest: ' || digest
            || {_BREAK} || 'source-header: HTTP/1.1 200 OK'
            || {_BREAK} || 'source-header: Content-Type: text/html; charset=utf-8'
            || {_BREAK} || 'source-header: Content-Length: ' || strlen(payload) || {_BREAK}
            || list_aggregate(list_concat([''], list_transform(regexp_extract_all(payload, {_sql(_LINK)}, 1),
                lambda x: 'outlink: ' || x || {_BREAK})), 'string_agg', '') AS block
        FROM r
        UNION ALL
        SELECT *, 'conversion', 'text/plain; charset=utf-8', {_sql_text()} FROM r)
    SELECT page_id, warc_type, '<urn:uuid:' || regexp_replace(md5(warc_type || '|' || source_id), {_UUID}) || '>' AS record_id,
        source_id AS refers_to, target_uri, '{DATE}' AS warc_date, content_type,
        CAST(strlen(block) AS BIGINT) AS content_length, 'sha256:' || sha256(block) AS block_digest,
        digest AS source_digest, block
    FROM m"""
