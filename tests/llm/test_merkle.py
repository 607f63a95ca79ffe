"""Merkle manifests against a tree built by hand."""

import hashlib
import zlib

import parity
import pytest
from pyspark.sql import functions as F

from chatterlake.llm import merkle, queries

SMALL = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, arity):
    """Root of a list of digests and, per place, its (left, right) siblings from below."""
    steps, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, at in enumerate(places):
            first = at - at % arity
            steps[leaf].append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + arity])))
            places[leaf] = at // arity
        nodes = [h(*nodes[a:a + arity]) for a in range(0, len(nodes), arity)]
    return nodes[0] if nodes else None, steps


def by_hand(rows, arity=8):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(*row), row))
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    built = {k: climb([x[2] for x in sorted(trees[k], key=lambda x: x[:3])], arity) for k in keys}
    root, upper = climb([built[k][0] for k in keys], arity)
    out = []
    for k, above in zip(keys, upper):
        for (_, _, leaf, row), steps in zip(sorted(trees[k], key=lambda x: x[:3]), built[k][1]):
            steps = steps + above
            digest = leaf
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                digest = leaf_of(*row[:4], None if row[4] is None else row[4].translate(LOWER))
            for left, right in steps:
                digest = h(left, digest, right)
            out.append((row[0], leaf, built[k][0], root, h(*(x for s in steps for x in s)), digest, digest == root))
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def table_of(spark, rows):
    return (spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("tree", F.lit(1)).withColumn("idx", F.lit("x"))
            .withColumn("digest", F.lit(2)).withColumn("left", F.lit(3)).withColumn("root", F.lit(4)))


def odd_rows():
    rows = [(i, "web", "en", 9, f"Text {i}") for i in range(75)]
    rows += [(i, None, None, None, None if i % 2 else "") for i in range(100, 103)]
    rows += [(200, "s", "é", 1, "Ä B"), (201, "s", "", 1, "long " * 20_000), (None, "s", "", 1, "no id"), (None, "s", "", 1, "no id")]
    rows += [(300, "s", "fr", 1, "Twice")] * 9 + [(300, "s", "fr", 2, "other")]
    return rows + [(400 + i, "s", f"l{i}", 1, "One") for i in range(12)]


def test_odd_rows(spark):
    got = merkle.verified_manifest(table_of(spark, odd_rows())).collect()
    assert sorted(map(tuple, got), key=str) == sorted(by_hand(odd_rows()), key=str)
    assert {r.verified for r in got} == {True, False}


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 65])
def test_sizes_of_one_tree(spark, n):
    rows = [(i, "s", "en", 1, "Some Text") for i in range(n)]
    got = merkle.verified_manifest(table_of(spark, rows)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(by_hand(rows), key=str)


@pytest.mark.parametrize("arity", [2, 3])
def test_other_arities(spark, arity):
    rows = odd_rows()[:20]
    got = merkle.manifest(table_of(spark, rows), arity=arity).withColumn(
        "folded", merkle.folded(F.col("leaf"), F.col("steps"))).collect()
    assert sorted((r.leaf, r.subroot, r.root) for r in got) == sorted(r[1:4] for r in by_hand(rows, arity))
    assert all(r.folded == r.root for r in got)


def test_joins_of_a_level_share_two_shuffles(spark, tmp_path):
    (spark.range(1000).select(F.lit("t").alias("tree"), F.col("id").alias("idx"), F.lit(1000).alias("n"),
                              F.sha2(F.col("id").cast("string"), 256).alias("digest"))
     .write.parquet(str(tmp_path / "nodes")))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        level = merkle.with_siblings(spark.read.parquet(str(tmp_path / "nodes")))
        plan = level._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # one for all left sides; the seven of the right sides are one and the same and are reused
    assert plan.count("SortMergeJoin") == 7 and plan.count("Exchange hashpartitioning") == 8


def test_query(spark):
    got = queries.QUERIES["op13_merkle"](spark, SMALL)
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "lang", "n_chars", "text").collect()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(by_hand(list(map(tuple, docs))), key=str)
    assert parity.differences(got, parity.duck(SMALL), queries.ORACLES["op13_merkle"]) == []
