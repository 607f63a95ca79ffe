"""SimHash near-duplicates, found exactly by vantage-point trees.

Distances to a vantage point are taken on disjoint groups of bits. On such a group the Hamming
distance obeys the triangle inequality, and the groups share one budget: if two fingerprints differ in
at most ``radius`` bits, the differences of their distances over all groups sum to at most ``radius``.
The upper tree cuts each of four 16-bit groups at quantiles of its distances; its cells are the shards.
A fingerprint is stored in one shard and visits each later shard whose bounds the budget can reach.
Within a shard two trees over eight 8-bit groups are walked together, and what the bounds leave is
compared. Distinct fingerprints alone take part, and a shard returns a spanning forest of its
links rather than all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.llm.common import batches, unused
from chatterlake.llm.components import components
from chatterlake.storage import fresh_path, write_table

SHINGLE = 4
RADIUS = 4
SEED = 42
SHARD_FINGERPRINTS = 1 << 17
#: Any 64-bit value serves as vantage point; this one is the golden ratio's fraction.
VANTAGE = 0x9E3779B97F4A7C15
_GROUPS = 4
_BITS = 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over XXH64 of the word shingles; 0 for a text without words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z alone, and ASCII white space alone
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    last = ends[shingle - 1:] if len(words) >= shingle else ends[-1:]
    starts = np.concatenate([[0], ends[:-1] + 1])[:len(last)]
    votes = np.zeros(64, np.int64)
    for part in batches(len(last), 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[part].tolist(), last[part].tolist())],
                     np.uint64)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, np.int64)
    return int.from_bytes(np.packbits(votes * 2 > len(last), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp: the fingerprint as a signed 64-bit integer. Null counts as empty."""

    def run(rows: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in rows:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(run, "doc_id bigint, fp bigint")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(group: int) -> Column:
    """Distance to the vantage point on one 16-bit group of the upper tree."""
    mask = ((1 << _BITS) - 1) << (_BITS * group)
    return F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(VANTAGE))).bitwiseAND(F.lit(_signed(mask))))


def _bands(distinct: DataFrame, shard_size: int) -> list[list[tuple[int, int]]]:
    """Inclusive distance bounds of the bands of each group, cut at quantiles.

    The driver sees 17 counts for each of four groups, whatever the size of the table.
    """
    counts = distinct.agg(*[
        F.count_if(_distance(g) == d).alias(f"{g}_{d}") for g in range(_GROUPS) for d in range(_BITS + 1)
    ]).first().asDict()
    total = sum(counts[f"0_{d}"] for d in range(_BITS + 1))
    wanted = 2
    while wanted ** _GROUPS * shard_size < total and wanted <= _BITS:
        wanted += 1
    out = []
    for g in range(_GROUPS):
        bands, start, seen = [], 0, 0
        for d in range(_BITS + 1):
            seen += counts[f"{g}_{d}"]
            if d == _BITS or len(bands) < wanted - 1 and seen * wanted >= total * (len(bands) + 1):
                bands.append((start, d))
                start = d + 1
        out.append([b for b in bands if b[0] <= b[1]])
    return out


def _visits(distinct: DataFrame, bands: list, radius: int, shard_size: int) -> DataFrame:
    """(cell, block, fp, stored): a row for the shard that stores a fingerprint and for each it visits.

    Of two shards the later one is visited. A cell with more than ``shard_size`` fingerprints is
    stored in blocks, and each of its visitors goes to every block.
    """
    out = distinct.withColumn("spent", F.lit(0)).withColumn("cell", F.lit(0)).withColumn("home", F.lit(0))
    for g, cuts in enumerate(bands):
        at = _distance(g)
        reach = F.array(*[
            F.struct(F.lit(b).alias("band"),
                     F.greatest(F.lit(0), F.lit(lo) - at, at - F.lit(hi)).alias("cost"))
            for b, (lo, hi) in enumerate(cuts)])
        own = F.filter(reach, lambda x: x.cost == 0)[0].band
        out = (
            out.withColumn("home", F.col("home") * len(cuts) + own)
            .withColumn("x", F.explode(F.filter(reach, lambda x: x.cost + F.col("spent") <= radius)))
            .withColumn("spent", F.col("spent") + F.col("x.cost"))
            .withColumn("cell", F.col("cell") * len(cuts) + F.col("x.band")).drop("x")
        )
    out = out.where("cell >= home").withColumn("at_home", F.col("spent") == 0)
    sizes = (out.where("at_home").groupBy("cell").count().where(F.col("count") > shard_size)
             .select("cell", F.ceil(F.col("count") / shard_size).alias("blocks")))
    blocks = F.coalesce("blocks", F.lit(1))
    own_block = F.when(F.col("at_home"), F.pmod(F.xxhash64("fp"), blocks)).otherwise(F.lit(0))
    return (
        out.join(sizes, "cell", "left")
        .withColumn("own_block", own_block)
        .withColumn("block", F.explode(F.sequence("own_block", blocks - 1)))
        .select("cell", "block", "fp", (F.col("at_home") & (F.col("block") == F.col("own_block"))).alias("stored"))
    )


def close_pairs(stored: np.ndarray, others: np.ndarray, radius: int,
                leaf: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of ``stored``, of ``stored`` then ``others``) within ``radius`` bits, each once."""
    every = np.concatenate([stored, others])
    rings = [np.bitwise_count((every ^ np.uint64(VANTAGE)) & np.uint64(0xFF << (8 * k))).astype(np.int8)
             for k in range(8)]
    todo = [(np.arange(len(stored)), np.arange(len(every)), radius, 0)]
    while todo:
        a, b, budget, level = todo.pop()
        if not len(a) or not len(b):
            continue
        if len(a) * len(b) <= leaf or level == 8:
            for part in batches(len(a), max(1, leaf // len(b))):
                i, j = np.nonzero(np.bitwise_count(every[a[part], None] ^ every[None, b]) <= radius)
                i, j = a[part][i], b[j]
                once = i < j
                yield i[once], j[once]
            continue
        ring = rings[level]
        left = [a[ring[a] == d] for d in range(9)]
        right = [b[ring[b] == d] for d in range(9)]
        todo += [(left[d], right[e], budget - abs(d - e), level + 1)
                 for d in range(9) for e in range(9) if abs(d - e) <= budget]


def _forest(stored: np.ndarray, others: np.ndarray, radius: int) -> np.ndarray:
    """For each of ``stored`` then ``others``, the least index of its linked group."""
    parent = np.arange(len(stored) + len(others))

    def root(i):
        i = parent[i]
        while True:
            up = parent[i]
            if np.array_equal(up, i):
                return i
            i = up

    for i, j in close_pairs(stored, others, radius):
        while len(i):
            i, j = root(i), root(j)
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(parent, np.maximum(i, j), np.minimum(i, j))
    return root(np.arange(len(parent)))


def links(distinct: DataFrame, radius: int = RADIUS, shard_size: int = SHARD_FINGERPRINTS) -> DataFrame:
    """Edges (a, b) between fingerprints of the column ``fp``, which join exactly what pairs within
    ``radius`` join, directly or through others."""
    if radius >= 8:
        raise ValueError("the trees are built for a radius below 8")

    def run(shard):
        import pandas as pd

        fps = shard["fp"].to_numpy().view(np.uint64)
        own = shard["stored"].to_numpy(bool)
        order = np.concatenate([np.sort(fps[own]), np.sort(fps[~own])])
        root = _forest(order[:own.sum()], order[own.sum():], radius)
        moved = root != np.arange(len(root))
        return pd.DataFrame({"a": order[moved].view(np.int64), "b": order[root[moved]].view(np.int64)})

    visits = _visits(distinct, _bands(distinct, shard_size), radius, shard_size)
    return visits.groupBy("cell", "block").applyInPandas(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS,
                    shard_size: int = SHARD_FINGERPRINTS) -> DataFrame:
    """One row per document: doc_id, fp, component_id.

    Documents are linked when their fingerprints differ in at most ``radius`` bits, and
    component_id is the smallest doc_id that links reach. Null and empty texts have fingerprint 0
    and are linked like any others. Repeated rows stay; a null doc_id takes part but is never the
    smallest unless no other is there. Other columns are ignored. An empty table gives no rows.
    """
    spark = docs.sparkSession
    fps = write_table(fingerprints(docs, text, shingle), fresh_path(spark, "fingerprints"))
    distinct = write_table(fps.groupBy("fp").agg(F.min("doc_id").alias("least")),
                           fresh_path(spark, "distinct-fingerprints"))
    edges = write_table(links(distinct.select("fp"), radius, shard_size), fresh_path(spark, "links"))
    groups = components(edges).select(F.col("node").alias("fp"), "component")
    labelled = write_table(
        distinct.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp")),
        fresh_path(spark, "labelled"))
    # a table of its own, so that the join shares no exchange and a large component can be split
    least = write_table(labelled.groupBy("component").agg(F.min("least").alias("component_id")),
                        fresh_path(spark, "least-ids"))
    linked = labelled.join(least, "component").select("fp", "component_id")
    return fps.join(linked, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near_duplicates(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component, with all columns."""
    found = near_duplicates(docs, text, **options)
    dropped = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    name = unused("dropped_id", docs)
    dropped = dropped.withColumnRenamed("doc_id", name)
    return docs.join(dropped, docs["doc_id"].eqNullSafe(dropped[name]), "left_anti")
