"""Exact duplicates with a heavy-hitter split.

One pass reduces every text to a digest. A frequent-items sketch over the digests (Spark's
``approx_top_k``: a Misra-Gries summary, kept per task and merged, of a fixed number of counters)
names the digests that may be frequent. Their true counts are then taken by an exact aggregation, and
the verified winners, at most ``counters`` rows, are broadcast: rows of frequent groups are decided in
the task that reads them. All other digests take an ordinary shuffle, in which no group can be large.
The sketch steers only the route of a row, never its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.llm.common import ascii_lower, unused
from chatterlake.storage import fresh_path, write_table

COUNTERS = 4096


def text_digest(text: str = "text"):
    return F.sha2(ascii_lower(F.col(text)).cast("binary"), 256)


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """Exact (digest, keeper, group_size) of groups that hold at least 1/``counters`` of the rows.

    The sketch tracks twice as many items as can be that frequent, so none of them is missed:
    its error is below rows / counters.
    """
    sketch = digests.agg(
        F.expr(f"approx_top_k(text_sha256, {counters}, {4 * counters})").alias("top"),
        F.count(F.lit(1)).alias("n"),
    )
    candidates = sketch.select("n", F.explode("top").alias("t")).select(
        F.col("t.item").alias("text_sha256"), F.greatest(F.lit(3), F.col("n") / counters).alias("least"))
    return (
        digests.join(F.broadcast(candidates), "text_sha256")  # at most `counters` rows
        .groupBy("text_sha256")
        .agg(F.max(_row()).alias("keeper"), F.count(F.lit(1)).alias("group_size"),
             F.first("least").alias("least"))
        .where(F.col("group_size") >= F.col("least")).drop("least")
    )


def _row():
    """Order of the rows of a group: the largest doc_id, of repeated rows the first."""
    return F.struct(F.col("doc_id"), (-F.col("row_no")).alias("order"))


def exact_duplicates(docs: DataFrame, text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty
    texts form one group. The row with the largest doc_id stays; a null doc_id sorts below all
    others. Where whole rows repeat, exactly one of them is kept. Columns other than doc_id and
    the text are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    digests = write_table(
        docs.select("doc_id", text_digest(text).alias("text_sha256"))
        .withColumn("row_no", F.monotonically_increasing_id()),
        fresh_path(spark, "digests"))
    heavy = write_table(frequent_digests(digests, counters), fresh_path(spark, "heavy-digests"))
    routed = digests.join(F.broadcast(heavy), "text_sha256", "left")  # at most `counters` rows
    settled = routed.where(F.col("group_size").isNotNull())
    group = Window.partitionBy("text_sha256")
    ordinary = (
        routed.where(F.col("group_size").isNull()).drop("keeper", "group_size")
        .withColumn("keeper", F.max(_row()).over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    return settled.unionByName(ordinary).select(
        "doc_id", F.col("keeper.doc_id").alias("keep_id"), "group_size",
        (F.col("row_no") == -F.col("keeper.order")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, text: str = "text", counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Copies within a frequent group are removed by the task that reads them; the rest move once,
    by digest.
    """
    spark = docs.sparkSession
    key, keep, rank = (unused(n, docs) for n in ("text_sha256", "keep_id", "rank"))
    keyed = docs.withColumn(key, text_digest(text))
    digests = write_table(
        keyed.select("doc_id", F.col(key).alias("text_sha256"))
        .withColumn("row_no", F.monotonically_increasing_id()),
        fresh_path(spark, "digests"))
    heavy = write_table(
        frequent_digests(digests, counters)
        .select(F.col("text_sha256").alias(key), F.col("keeper.doc_id").alias(keep)),
        fresh_path(spark, "heavy-digests"))
    left = keyed.join(F.broadcast(heavy), key, "left").where(
        F.col(keep).isNull() | F.col(keep).eqNullSafe(F.col("doc_id")))
    order = Window.partitionBy(key).orderBy(F.col("doc_id").desc())
    return left.withColumn(rank, F.row_number().over(order)).where(F.col(rank) == 1).select(*docs.columns)


ORACLE = """
    WITH d AS (
        SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                        'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
        FROM documents)
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, text_sha256
    FROM d WINDOW w AS (PARTITION BY text_sha256)"""
