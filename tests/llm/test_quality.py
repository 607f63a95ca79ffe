"""Held-out accuracy of the quality classifier and its odd rows."""

import zlib

import numpy as np
import pytest

from chatterlake.llm import quality, queries

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def test_held_out_documents(spark):
    got = {r.doc_id: r for r in queries.QUERIES["op1_quality"](spark, MEDIUM).collect()}
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    assert len(got) == docs.count()
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()
    held = [(r.quality, got[r.doc_id]) for r in labels if r.doc_id in got and got[r.doc_id].held_out]
    good, bad = [x.score for y, x in held if y], [x.score for y, x in held if not y]
    wins = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert wins > 0.95 and np.mean([s >= 0.3 for s in good]) > 0.98
    assert all(x.predicted == int(x.score >= 0.3) for x in got.values())
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, x in got.items())


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "word " * 40000, "en"), (None, "a b", "en"), (3, "word " * 40000, "en"),
            (5, "퟿ x\x00y", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(3, 1), (3, 0), (1, None), (77, 0), (2, 0)], "doc_id long, label int")
    weights = quality.train(docs, labels)
    out = quality.score(docs, weights)
    assert out.columns == ["doc_id", "text", "score"] and out.count() == len(rows)
    scores = {r.doc_id: r.score for r in out.collect()}
    assert scores[1] == scores[2] and all(0 <= s <= 1 for s in scores.values())
    assert scores[3] > scores[1]
    none = quality.train(docs, labels.limit(0))
    assert not none.any() and {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert quality.score(docs.limit(0), weights).count() == 0


def test_leader_by_one_step():
    # first gradient of a row (x = 1, label 1) is -0.5: z = -0.5, n = 0.25
    w = quality.follow_the_leader([(np.array([0]), np.array([1.0]), 1)], 1, 1, alpha=1.0, beta=1.0, l1=0.0, l2=0.5)
    assert w[0] == pytest.approx(0.5 / (1.5 + 0.5))
