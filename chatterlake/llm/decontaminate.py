"""Benchmark decontamination with a distributed positional inverted index.

The index holds a posting (term, document, position) for every place of the corpus where a term of
the benchmark stands. A term is a word with its successor, the form in which rare terms of a phrase
are far rarer than its words; an item of one word has that word as its term. A phrase is looked up
from its rarest term: each of that term's postings, moved back by the term's offset, proposes a place,
and the postings of the other terms, moved by theirs, confirm it. Windows of an item that propose the same
alignment share that work. Only the benchmark's own terms and windows are broadcast, and only after
they have been counted; larger benchmarks take ordinary joins.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.llm.common import unused
from chatterlake.storage import fresh_path, write_table

WINDOW = 10
#: Largest benchmark-derived table that is broadcast, in rows.
BROADCAST_ROWS = 500_000

#: ASCII characters outside words; all others are parts of words.
_GAPS = "".join(map(chr, [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))
_DOC = ["row"]


def _row(text: str) -> Column:
    """Names the rows of one doc_id and text; null ids are values like others."""
    return F.struct(F.coalesce(F.col("doc_id"), F.lit(-1)).alias("id"), F.col("doc_id").isNull().alias("none"),
                    F.xxhash64(text).alias("text"))


def words(text: Column) -> Column:
    """Lower-cased words of ASCII letters, digits and any non-ASCII characters; null has none."""
    plain = F.translate(F.coalesce(text, F.lit("")), _GAPS + string.ascii_uppercase,
                        " " * len(_GAPS) + string.ascii_lowercase)
    return F.array_remove(F.split(plain, " "), "")


def _checked(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast if its counted rows are within the bound."""
    stored = write_table(df, fresh_path(df.sparkSession, "benchmark"))
    return F.broadcast(stored) if stored.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else stored


def item_terms(items: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, item_id, offset, word, next, term, need): the terms of every item with a word.

    ``need`` is the number of consecutive terms in one of its windows.
    """
    w = items.select("item_id", F.xxhash64("item_id", text).alias("item"), words(F.col(text)).alias("w"))
    pairs = w.where("size(w) > 1").select(
        "item_id", "item", (F.least(F.size("w"), F.lit(window)) - 1).alias("need"),
        F.posexplode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("word"),
                                  F.expr("slice(w, 2, size(w) - 1)").alias("next"))).alias("offset", "t"),
    ).select("item_id", "item", "need", "offset", "t.word", "t.next")
    single = w.where("size(w) = 1").select(
        "item_id", "item", F.lit(1).alias("need"), F.lit(0).alias("offset"), F.col("w")[0].alias("word"),
        F.lit(None).cast("string").alias("next"))
    return pairs.unionByName(single).dropDuplicates(["item_id", "item", "offset"]).withColumn(
        "term", F.xxhash64("word", "next"))


def build_index(docs: DataFrame, terms: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Write and return the postings (row, pos, term) of ``terms`` in whole texts."""
    w = docs.select(_row(text).alias("row"), words(F.col(text)).alias("w"))
    dictionary = _checked(terms.select("word", "next", "term").distinct())
    pairs = w.where("size(w) > 1").select(
        *_DOC, F.posexplode(F.arrays_zip(F.col("w").alias("word"), F.expr("slice(w, 2, size(w))").alias("next")))
        .alias("pos", "t")).select(*_DOC, "pos", "t.word", "t.next")
    single = w.select(*_DOC, F.posexplode("w").alias("pos", "word"))
    found = pairs.join(dictionary, ["word", "next"]).select(*_DOC, "pos", "term").unionByName(
        single.join(dictionary.where("next IS NULL"), "word").select(*_DOC, "pos", "term"))
    return write_table(found, path)


def _proposals(index: DataFrame, terms: DataFrame, window: int, whole: bool = True) -> DataFrame:
    """(item, row, shift): alignments proposed by the rarest term of a window, each once.

    A window with an absent term proposes nothing if its ``whole`` phrase is looked for.
    """
    frequency = index.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    counted = terms.join(frequency, "term", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    inside = Window.partitionBy("item_id", "item").orderBy("offset").rowsBetween(0, window - 2)
    rarest = (
        counted.withColumn("pick", F.min(F.when(F.lit(whole) | (F.col("n") > 0), F.struct("n", "offset", "term")))
                           .over(inside))
        .withColumn("size", F.count(F.lit(1)).over(inside))
        .where((F.col("size") >= F.col("need")) & (F.col("pick.n") > 0))
        .select("item", F.col("pick.offset").alias("offset"), F.col("pick.term").alias("term")).distinct()
    )
    return index.join(_checked(rarest), "term").select(
        "item", *_DOC, (F.col("pos") - F.col("offset")).alias("shift")).distinct()


def phrase_matches(index: DataFrame, terms: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item, row, first, last): word positions of maximal runs of whole windows."""
    proposals = _proposals(index, terms, window)
    once = _checked(terms.select("item", "offset", "term", "need", F.col("next").isNotNull().alias("pair")).distinct())
    places = proposals.join(once, "item").withColumn("pos", F.col("shift") + F.col("offset"))
    confirmed = places.join(index.distinct(), [*_DOC, "pos", "term"])
    alignment = ["item", *_DOC, "shift"]
    run = F.col("offset") - F.row_number().over(Window.partitionBy(*alignment).orderBy("offset"))
    return (
        confirmed.withColumn("run", run).groupBy(*alignment, "run", "need", "pair")
        .agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count(F.lit(1)).alias("n"))
        .where("n >= need")
        .select("item", *_DOC, "first", (F.col("last") + F.col("pair").cast("int")).alias("last"))
    )


def proximity_matches(index: DataFrame, terms: DataFrame, slop: int = 5, share: float = 0.8,
                      window: int = WINDOW) -> DataFrame:
    """(item, row, shift, found): items of which at least ``share`` of the terms stand
    within ``slop`` words of their place in an alignment proposed by a rarest term."""
    proposals = _proposals(index, terms, window, whole=False)
    once = terms.select("item", "offset", "term").distinct()
    total = once.groupBy("item").agg(F.count(F.lit(1)).alias("total"))
    near = (
        proposals.join(_checked(once), "item").join(index.distinct(), [*_DOC, "term"])
        .where(F.abs(F.col("pos") - F.col("offset") - F.col("shift")) <= slop)
        .groupBy("item", *_DOC, "shift").agg(F.count_distinct("offset").alias("found"))
    )
    return near.join(_checked(total), "item").where(F.col("found") >= share * F.col("total")).drop("total")


def contamination(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit inside any occurrence of ``window`` consecutive words of an item, or of a whole
    shorter item. Null and empty texts have no words and are clean; items without words match
    nothing; an item_id that is null counts in n_hit only. Rows that repeat a doc_id and text each get the
    same figures, rows that share a doc_id with another text their own. Other columns are ignored.
    An empty table gives no rows.
    """
    spark = docs.sparkSession
    terms = write_table(item_terms(items, text="text", window=window), fresh_path(spark, "item-terms"))
    index = build_index(docs, terms, fresh_path(spark, "postings"), text)
    runs = write_table(phrase_matches(index, terms, window), fresh_path(spark, "phrases"))
    hits = (
        runs.select(*_DOC, F.explode(F.sequence("first", "last")).alias("pos")).distinct()
        .groupBy(*_DOC).agg(F.count(F.lit(1)).alias("n_hit"))
    )
    named = (
        runs.select("item", *_DOC).distinct()
        .join(_checked(terms.select("item", "item_id").distinct()), "item")
        .groupBy(*_DOC).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("ids"))
    )
    every = docs.select("doc_id", _row(text).alias("row"), F.size(words(F.col(text))).cast("bigint").alias("n_words"))
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return (
        every.join(hits, _DOC, "left").join(named, _DOC, "left")
        .withColumn("n_hit", F.coalesce("n_hit", F.lit(0).cast("bigint")))
        .select(
            "doc_id", "n_words", "n_hit", F.size(ids).cast("bigint").alias("n_items"),
            F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
            (F.col("n_hit") > 0).alias("contaminated"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` without any hit, with all their columns."""
    spark = docs.sparkSession
    terms = write_table(item_terms(items, window=window), fresh_path(spark, "item-terms"))
    index = build_index(docs, terms, fresh_path(spark, "postings"), text)
    dirty = phrase_matches(index, terms, window).select("row").distinct()
    name = unused("row", docs)
    return docs.withColumn(name, _row(text)).join(
        dirty.withColumnRenamed("row", name), name, "left_anti").select(*docs.columns)


ORACLE = """
    WITH d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM documents),
    b AS (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
            'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+') AS w FROM benchmark),
    win AS (
        SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (
            SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
            FROM b WHERE len(w) > 0)),
    occ AS (
        SELECT doc_id, i, n, item_id FROM (
            SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase FROM (
                SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n))
        JOIN win USING (n, phrase)),
    hit AS (
        SELECT doc_id, count(*) AS n_hit FROM (
            SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS pos FROM occ) GROUP BY doc_id),
    ids AS (
        SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (
            SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM occ) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(ids.ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id"""
