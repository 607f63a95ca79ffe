"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chatterlake.storage import fresh_path, write_table


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")),
                           F.bit_xor(F.xxhash64("b", "a"))).first())


def _to_least(edges: DataFrame) -> DataFrame:
    """Each node's neighbours below and itself are tied to the least of them.

    ``edges`` has the larger node in ``a``; the least is taken by an aggregation that runs before the
    shuffle, so no neighbourhood is ever gathered.
    """
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).where("a != b").distinct()


def _from_all(edges: DataFrame) -> DataFrame:
    """Each node's neighbours above are tied to the least of the node and all its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return (both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a != b").distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node.

    Every round is a written table, so lineage stays short and a lost executor only rereads files.
    The number of rounds grows with the logarithm of the longest chain.
    """
    spark = edges.sparkSession
    start = (edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
             .where("a != b").distinct())
    current = write_table(start, fresh_path(spark, "stars"))
    before, mark = None, _mark(current)
    while mark != before:
        current = write_table(_to_least(_from_all(current)), fresh_path(spark, "stars"))
        before, mark = mark, _mark(current)
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
