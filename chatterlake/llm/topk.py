"""Exact top-k by inner product with the no-random-access algorithm.

Vectors are kept as shards of sorted lists: for every dimension the components of a shard's vectors
in falling order, each with the vector's position. A block of queries reads the lists of a shard in
step, from both ends, and remembers what it has seen of each vector. A component that has not been
seen yet lies between the last values read at the two ends of its list, which gives every vector a
lower and an upper bound of its score for each query. A query is settled when few vectors are left
whose upper bound reaches the k-th lower bound, so that no other can qualify; the final scores of
those left are resolved by reading on for them alone. No vector is ever looked up by its position.

Shards are made in the task that reads the vectors. Shards and blocks of queries meet in cells, each a group of
shards and a bounded number of queries. A task holds the queries of one cell and their best k so far, and reads the
shards of the cell one after the other, so no row of lists is copied per block and a cell gives k rows a query.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.llm.common import arrow_rows
from chatterlake.storage import fresh_path, write_table

K = 5
SCALE = 256
SHARD_VECTORS = 16_384
BLOCK_QUERIES = 64
#: Queries that a task holds at a time, in blocks.
CELL_QUERIES = 16_384
#: Groups of shards; with more shards, one for every ``GROUP_SHARDS``.
GROUPS, GROUP_SHARDS = 256, 16
#: Row groups of the lists: a row is some megabytes, and a writer holds a row group.
LISTS_MB = 16
#: Shares of the lists after which bounds are compared.
STOPS = (0.125, 0.25, 0.5, 0.625, 0.75, 0.875, 1)
#: A query is settled when so small a share of the vectors is left.
LEFT = 1 / 16
_EXACT = 2.0 ** 53  # below this, sums of whole numbers are exact in double arithmetic

_LISTS = "shard bigint, dims int, names binary, order binary, values binary, width int"
_BLOCKS = "block bigint, dims int, names binary, components binary, width int"
_FOUND = "query_row bigint, query_id bigint, vec_row bigint, vec_id bigint, score bigint"


class Lists(NamedTuple):
    """The sorted lists of one shard: dimension x depth, largest component first."""

    order: np.ndarray  # position of the vector
    values: np.ndarray  # its component


def sorted_lists(vectors: np.ndarray) -> Lists:
    """Lists of ``vectors`` (vector x dimension); equal components in the order of positions."""
    columns = np.ascontiguousarray(vectors.T)
    order = np.argsort(-columns, axis=1, kind="stable")
    return Lists(order, np.take_along_axis(columns, order, axis=1))


def no_random_access(queries: np.ndarray, lists: Lists, k: int, skips: list[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the positions and scores of every vector that may belong to its best ``k``.

    ``skips`` has a position that is no candidate of the query, or -1. The scores are final, and all
    vectors that tie with the k-th best are among them.
    """
    dims, n = lists.order.shape
    reach = max((sum(abs(int(q)) * int(v) for q, v in zip(query, np.abs(lists.values[:, [0, -1]]).max(1)))
                 for query in queries), default=0)
    if reach >= 2 ** 61:
        raise OverflowError("a score does not fit into 62 bits")
    kind = np.float64 if reach < _EXACT / 4 else np.int64
    queries, values = queries.astype(kind), lists.values.astype(kind, copy=False)
    known, unseen = np.zeros((n, dims), kind), np.ones((n, dims), kind)
    dimension = np.arange(dims)[:, None]
    left: list[np.ndarray] = [np.delete(np.arange(n), skip) if skip >= 0 else np.arange(n) for skip in skips]
    active = np.arange(len(queries)) if n > k else np.empty(0, np.int64)
    half, depth = -(-n // 2), 0
    for stop in STOPS:
        if not len(active):
            break
        upto = max(depth, int(half * stop))
        for rows in (slice(depth, upto), slice(max(n - upto, upto), n - depth)):
            at = lists.order[:, rows]
            known[at, dimension] = values[:, rows]
            unseen[at, dimension] = 0
        depth = upto
        if not depth:
            continue
        asked = queries[active]
        ends = asked * values[:, depth - 1], asked * values[:, n - depth]
        lower = asked @ known.T
        upper = lower + np.maximum(*ends) @ unseen.T
        lower += np.minimum(*ends) @ unseen.T
        for i, number in enumerate(active.tolist()):
            if skips[number] >= 0:
                lower[i, skips[number]] = upper[i, skips[number]] = -4 * max(reach, 1)
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        alive = upper >= kth[:, None]
        settled = alive.sum(1) <= max(n * LEFT, k)
        for i, number in enumerate(active.tolist()):
            if settled[i] or depth == half:
                left[number] = np.flatnonzero(alive[i] & (lower[i] > -4 * max(reach, 1)))
        active = active[~settled]
    # resolve: read on, but only for those that are left
    rows = np.unique(np.concatenate(left)) if left else np.empty(0, np.int64)
    place = np.full(n, -1)
    place[rows] = np.arange(len(rows))
    resolved = known[rows]
    rest = place[lists.order[:, depth:max(n - depth, depth)]]
    where, entry = np.nonzero(rest >= 0)
    resolved[rest[where, entry], where] = values[where, depth + entry]
    return [(at, (resolved[place[at]] @ query).astype(np.int64)) for at, query in zip(left, queries)]


def whole_components(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null for vectors that take no part.

    Those are null and empty vectors and those with a null or non-finite component.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(vector) > 0) & finite,
                  F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _bytes(values, kind) -> bytes:
    return np.asarray(values, kind).tobytes()


def _narrow(values: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers in as few bytes each as hold them all, and how many those are."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return _bytes(values, f"<i{width}"), width


def _names(numbers: list[int], ids: list) -> bytes:
    """Row number, id and whether the id is null, of each vector."""
    return _bytes([[r, i or 0, i is None] for r, i in zip(numbers, ids)], "<i8")


def _batch(schema: str, rows: list[tuple]):
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[t]) for c, t in zip(zip(*rows) if rows else [[]] * len(names), types)], names=names)


def _gathered(rows: Iterator, size: int) -> Iterator[tuple]:
    """(dims, row numbers, ids, vectors) of at most ``size`` rows of equal length each."""
    held: dict[int, tuple[list, list, list]] = {}

    def taken(dims: int) -> tuple:
        numbers, ids, parts = held.pop(dims)
        return dims, numbers, ids, np.stack(parts)

    for batch in rows:
        vectors = batch.column(2)
        flat = vectors.flatten().to_numpy(zero_copy_only=False)
        ends = np.cumsum(vectors.value_lengths().to_numpy(zero_copy_only=False))
        starts = np.append(0, ends[:-1])
        for number, vec_id, a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                        starts.tolist(), ends.tolist()):
            group = held.setdefault(b - a, ([], [], []))
            for part, value in zip(group, (number, vec_id, flat[a:b].copy())):
                part.append(value)
            if len(group[0]) == size:
                yield taken(b - a)
    for dims in list(held):
        yield taken(dims)


def _list_rows(rows: Iterator, size: int) -> Iterator:
    for dims, numbers, ids, vectors in _gathered(rows, size):
        lists = sorted_lists(vectors)
        yield _batch(_LISTS, [(
            numbers[0], dims, _names(numbers, ids),
            _bytes(lists.order, "<u2" if size <= 65_536 else "<u4"), *_narrow(lists.values))])


def _block_rows(rows: Iterator, size: int) -> Iterator:
    for dims, numbers, ids, vectors in _gathered(rows, size):
        yield _batch(_BLOCKS, [(numbers[0], dims, _names(numbers, ids), *_narrow(vectors))])


class _Block:
    """A block of queries with the best ``k`` of the shards that it has met."""

    def __init__(self, names: bytes, components: bytes, width: int, dims: int, k: int) -> None:
        self.asking = np.frombuffer(names, "<i8").reshape(-1, 3)
        self.components = np.frombuffer(components, f"<i{width}").reshape(-1, dims)
        self.k = k
        self.best: list[np.ndarray] = [np.empty((0, 4), np.int64)] * len(self.asking)

    def meet(self, names: np.ndarray, place: dict[int, int], lists: Lists) -> None:
        answers = no_random_access(self.components.astype(np.int64), lists, self.k,
                                   [place.get(row, -1) for row in self.asking[:, 0].tolist()])
        for i, (at, scores) in enumerate(answers):
            found = np.concatenate([self.best[i], np.column_stack([names[at], scores])])
            row, vec_id, missing, score = found.T
            self.best[i] = found[np.lexsort((row, vec_id, missing, -score))[:self.k]]

    def rows(self) -> list[tuple]:
        return [(query_row, None if unnamed else query_id, row, None if missing else vec_id, score)
                for (query_row, query_id, unnamed), best in zip(self.asking.tolist(), self.best)
                for row, vec_id, missing, score in best.tolist()]


def _answers(rows: Iterator, k: int, wide: bool) -> Iterator:
    """The best ``k`` of each query in each cell, for rows in the order of cells, a cell's blocks before its shards."""
    cell, blocks = None, []
    for batch in rows:
        for r in range(batch.num_rows):
            *here, shard, dims, names, order, data, width = (batch.column(i)[r].as_py() for i in range(batch.num_columns))
            if here != cell:
                yield from (_batch(_FOUND, block.rows()) for block in blocks)
                cell, blocks = here, []
            if shard is None:
                blocks.append(_Block(names, data, width, dims, k))
                continue
            if not blocks:
                continue
            names = np.frombuffer(names, "<i8").reshape(-1, 3)
            values = np.frombuffer(data, f"<i{width}").reshape(dims, -1).astype(np.int64)
            lists = Lists(np.frombuffer(order, "<u4" if wide else "<u2").reshape(dims, -1), values)
            if np.abs(values).max() < _EXACT:
                lists = lists._replace(values=values.astype(np.float64))  # once for all queries
            place = {row: i for i, row in enumerate(names[:, 0].tolist())}
            for block in blocks:
                block.meet(names, place, lists)
    yield from (_batch(_FOUND, block.rows()) for block in blocks)


def write_lists(vectors: DataFrame, path: str, shard_vectors: int = SHARD_VECTORS) -> DataFrame:
    """Write the sorted lists of ``vectors`` (row, vec_id, components), a row a shard.

    A shard holds at most ``shard_vectors`` vectors of one length that one task has read.
    """
    lists = vectors.mapInArrow(lambda rows: _list_rows(rows, shard_vectors), _LISTS)
    # sizes are looked at after every row: by default only after a hundred
    (lists.write.option("parquet.block.size", LISTS_MB << 20).option("parquet.block.size.row.check.min", 1)
     .option("parquet.block.size.row.check.max", 1).option("parquet.page.size.row.check.min", 1)
     .option("parquet.page.size.row.check.max", 1).option("parquet.enable.dictionary", "false")
     .mode("overwrite").parquet(path))
    return vectors.sparkSession.read.schema(_LISTS).parquet(path)


def _cells(lists: DataFrame, blocks: DataFrame, cell_blocks: int) -> DataFrame:
    """Blocks (``shard`` is null) and shards by the cells in which they meet, each cell a run of rows.

    A cell is a length of vectors, a group of shards and a part of the blocks. Blocks go to every group, shards to
    every part.
    """
    n = lists.count()
    groups = max(GROUPS, n // GROUP_SHARDS)
    parts = max(1, -(-blocks.count() // cell_blocks))
    grouped = lists.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(groups)))
    of_part = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
    places = grouped.select("dims", "group").distinct()
    asked = of_part.join(F.broadcast(places), "dims").select(
        "dims", "group", "part", F.lit(None).cast("bigint").alias("shard"), "names",
        F.lit(None).cast("binary").alias("order"), F.col("components").alias("data"), "width")
    met = grouped.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<bigint>"))).select(
        "dims", "group", "part", "shard", "names", "order", F.col("values").alias("data"), "width")
    cells = min(n, groups) * parts
    return (asked.unionByName(met).repartition(max(1, min(2 * cells, 2048)), "dims", "group", "part")
            .sortWithinPartitions("dims", "group", "part", F.asc_nulls_first("shard"))
            .select(F.col("dims").alias("length"), "group", "part", "shard", "dims", "names", "order", "data", "width"))


def top_k(embeddings: DataFrame, is_query: Column, k: int = K, vec_id: str = "vec_id", vector: str = "embedding",
          shard_vectors: int = SHARD_VECTORS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """The ``k`` highest inner products of every query row: query_id, rank, vec_id, score.

    Queries are the rows where ``is_query`` holds (null: no query); candidates are all rows but the
    query's own, so repeated rows, and other rows with the query's id, are candidates. Ties go to the
    smaller vec_id, a null vec_id last. Components are floor(256 * x) as whole numbers, sums are
    exact (an error where they could pass 2^61). Vectors that are null, empty or hold null or non-finite
    components take no part; of vectors of different lengths only equal lengths meet. Other
    columns are ignored. Fewer than ``k`` candidates give fewer rows, an empty table none.
    """
    spark = embeddings.sparkSession
    rows = write_table(
        embeddings.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
                          whole_components(F.col(vector)).alias("components"))
        .where(F.col("components").isNotNull())
        .select(F.monotonically_increasing_id().alias("row"), "vec_id", "components", "asks"),
        fresh_path(spark, "vectors"))
    lists = write_lists(rows.drop("asks"), fresh_path(spark, "sorted-lists"), shard_vectors)
    blocks = write_table(
        rows.where("asks").select("row", "vec_id", "components")
        .mapInArrow(lambda part: _block_rows(part, block_queries), _BLOCKS), fresh_path(spark, "query-blocks"))
    wide = shard_vectors > 65_536
    with arrow_rows(spark, 1):  # a row is a shard
        found = write_table(
            _cells(lists, blocks, max(1, CELL_QUERIES // block_queries))
            .mapInArrow(lambda part: _answers(part, k, wide), _FOUND), fresh_path(spark, "cell-answers"))
    order = Window.partitionBy("query_row").orderBy(
        F.desc("score"), F.asc_nulls_last("vec_id"), "vec_row")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE = """
    WITH v AS (
        SELECT row_number() OVER () AS r, vec_id,
               list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS c
        FROM embeddings
        WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    scored AS (
        SELECT q.r, q.vec_id AS query_id, v.vec_id, v.r AS vec_row,
               CAST(list_sum(list_transform(list_zip(q.c, v.c), lambda p: p[1] * p[2])) AS BIGINT) AS score
        FROM v q JOIN v ON q.r <> v.r AND len(q.c) = len(v.c) WHERE q.vec_id % 50 = 0)
    SELECT query_id, CAST(row_number() OVER (
               PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, vec_row) AS INTEGER) AS rank, vec_id, score
    FROM scored
    QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, vec_row) <= 5"""
