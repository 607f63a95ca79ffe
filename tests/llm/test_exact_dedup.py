"""Exact duplicates: SQL twin, hot groups on either route, odd rows."""

import hashlib
from collections import defaultdict

import parity
import pytest
from pyspark.sql import functions as F

from chatterlake.llm import exact_dedup, queries

SMALL = "/root/testdata/sf0.001"


def test_same_as_sql(spark):
    query = queries.QUERIES["op3_exact_dedup"](spark, SMALL)
    assert parity.differences(query, parity.duck(SMALL), queries.ORACLES["op3_exact_dedup"]) == []


def norm(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


ROWS = ([(i, "Hot TEXT") for i in range(50)] + [(i, "hot text") for i in range(50, 80)]
        + [(100 + i, f"É{i % 7}") for i in range(20)] + [(200, None), (201, ""), (None, ""), (None, "only null id")]
        + [(300, "twice"), (300, "twice"), (301, "É"), (302, "é"), (303, "x" * 70000), (304, "X" * 70000)])


@pytest.mark.parametrize("counters", [4, 4096])
def test_odd_rows_by_either_route(spark, counters):
    docs = spark.createDataFrame([(*r, "c", 5) for r in ROWS],
                                 "doc_id long, text string, keep_id string, group_size int").repartition(4)
    got = exact_dedup.exact_duplicates(docs, counters=counters).collect()
    groups = defaultdict(list)
    for doc_id, text in ROWS:
        groups[norm(text)].append(doc_id)
    by_digest = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    assert len(got) == len(ROWS)
    kept = defaultdict(list)
    for r in got:
        ids = by_digest[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        if r.kept:
            kept[r.text_sha256].append(r.doc_id)
    assert {d: [max((i for i in ids if i is not None), default=None)] for d, ids in by_digest.items()} == dict(kept)
    rest = exact_dedup.drop_exact_duplicates(docs, counters=counters)
    assert rest.columns == docs.columns
    assert sorted(map(str, (r.doc_id for r in rest.collect()))) == sorted(str(x[0]) for x in kept.values())


def test_hot_group_is_found_and_bounded(spark):
    digests = spark.range(20_000).select(
        "id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text_sha256"),
        F.col("id").alias("doc_id"), F.col("id").alias("row_no"))
    heavy = exact_dedup.frequent_digests(digests, 64).collect()
    assert [(r.text_sha256, r.group_size, r.keeper.doc_id) for r in heavy] == [("hot", 6667, 19998)]


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.exact_duplicates(none).count() == 0
    assert exact_dedup.drop_exact_duplicates(none).count() == 0
