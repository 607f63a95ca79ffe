"""No-random-access top-k against plain products."""

import numpy as np
import parity
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chatterlake.llm import queries, topk

SMALL = "/root/testdata/sf0.001"
whole = st.integers(-9, 9)


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 4).flatmap(lambda d: st.tuples(
    st.lists(st.lists(whole, min_size=d, max_size=d), min_size=1, max_size=4),
    st.lists(st.lists(whole, min_size=d, max_size=d), min_size=1, max_size=60))),
    st.integers(1, 5), st.integers(-1, 3), st.sampled_from([1, 10 ** 9, 10 ** 15]))
def test_algorithm_finds_the_best_and_their_ties(case, k, skip, factor):
    asked, vectors = np.array(case[0]), np.array(case[1]) * factor
    skip = min(skip, len(vectors) - 1)
    answers = topk.no_random_access(asked, topk.sorted_lists(vectors), k, [skip] * len(asked))
    for query, (at, scores) in zip(asked, answers, strict=True):
        true = vectors @ query
        assert (true[at] == scores).all() and skip not in at.tolist()
        others = np.delete(true, skip) if skip >= 0 else true
        kth = np.sort(others)[::-1][:k][-1] if len(others) else None
        assert {i for i in range(len(true)) if i != skip and true[i] >= kth} <= set(at.tolist())


def test_reading_stops_before_the_end():
    # one vector far above all others: it is known from the upper ends, and no other can reach it
    vectors = np.arange(1600 * 4).reshape(1600, 4) % 97
    vectors[7] = 1000
    lists = topk.sorted_lists(vectors)
    at, scores = topk.no_random_access(np.ones((1, 4), np.int64), lists, 1, [-1])[0]
    assert 7 in at.tolist() and scores.max() == 4000 and len(at) <= 100


def test_scores_beyond_their_bits_are_an_error():
    lists = topk.sorted_lists(np.array([[2 ** 40]]))
    with pytest.raises(OverflowError):
        topk.no_random_access(np.array([[2 ** 40]]), lists, 1, [-1])


def expected(rows, k=5):
    """(query_id, rank, vec_id, score) by plain products."""
    kept = [(i, v, [int(np.floor(256 * float(x))) for x in c]) for i, (v, c) in enumerate(rows)
            if c and all(x is not None and np.isfinite(x) for x in c)]
    out = []
    for i, v, c in kept:
        if v is None or v % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(c, d)), w is None, w or 0, j)
                        for j, w, d in kept if j != i and len(d) == len(c))
        out += [(v, n + 1, None if none else w, -s) for n, (s, none, w, _) in enumerate(scored[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard,block", [(3, 2), (16_384, 256)])
def test_odd_rows(spark, shard, block):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (50, [1.0, 0.5]), (50, [-1.0, 2.0]), (7, [1.0, 0.5]), (None, [1.0, 0.5]),
            (1, None), (2, []), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0]), (100, [3.0]), (101, [-0.001]),
            (200, [None, 1.0]), (8, [0.0, 0.0]), (9, [-0.5, -0.25])]
    df = (spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
          .withColumn("score", F.lit("x")).withColumn("row", F.lit(1)).withColumn("dims", F.lit(2)))
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, shard_vectors=shard, block_queries=block).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_cells_of_many_parts_and_groups(spark, monkeypatch):
    """A cell gives k rows a query, however many shards it holds, and a row of lists goes to a part once."""
    monkeypatch.setattr(topk, "CELL_QUERIES", 4)
    monkeypatch.setattr(topk, "GROUPS", 2)
    rng = np.random.default_rng(5)
    rows = [(int(i * 25), [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(60, 3)) * [1, 1000, 1e-3])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    paths = []
    monkeypatch.setattr(topk, "fresh_path", lambda spark, name, path=topk.fresh_path: paths.append(path(spark, name)) or paths[-1])
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, shard_vectors=2, block_queries=2).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)
    answers = spark.read.parquet(next(p for p in paths if "answers" in p))
    assert answers.groupBy("query_row").count().agg(F.max("count")).first()[0] <= 2 * topk.K


def test_lists_are_written_in_small_row_groups(spark, tmp_path):
    import pyarrow.dataset as ds

    rows = spark.range(0, 80_000, 1, 1).select(F.col("id").alias("row"), F.col("id").alias("vec_id"), F.array(
        *[F.pmod(F.xxhash64("id", F.lit(i)), F.lit(4001)) - 2000 for i in range(64)]).alias("components"))
    topk.write_lists(rows, str(tmp_path / "lists"), 4096)
    sizes = [g.total_byte_size for f in ds.dataset(tmp_path / "lists").get_fragments() for g in f.row_groups]
    assert len(sizes) > 1 and max(sizes) < 2 * topk.LISTS_MB << 20


def test_empty_table_and_no_queries(spark):
    df = spark.createDataFrame([(1, [1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(df.limit(0), F.lit(True)).count() == 0


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = queries.QUERIES["op11_topk"](spark, SMALL)
    assert sorted(map(tuple, got.collect()), key=str) == expected(rows)
    assert parity.differences(got, parity.duck(SMALL), queries.ORACLES["op11_topk"]) == []
