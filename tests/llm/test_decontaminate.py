"""Phrase lookup through the positional index against brute force."""

import hashlib
import re

import parity
import pytest

from chatterlake.llm import decontaminate, queries
from chatterlake.storage import fresh_path

SMALL = "/root/testdata/sf0.001"


def words(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items):
    windows = []
    for item_id, text in items:
        w = words(text)
        n = min(10, len(w))
        windows += [(item_id, tuple(w[i:i + n])) for i in range(len(w) - n + 1) if n]
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, phrase in windows:
            for i in range(len(w) - len(phrase) + 1):
                if tuple(w[i:i + len(phrase)]) == phrase:
                    hit |= set(range(i, i + len(phrase)))
                    ids.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return out


def test_same_as_sql(spark):
    query = queries.QUERIES["op7_decontaminate"](spark, SMALL)
    assert parity.differences(query, parity.duck(SMALL), queries.ORACLES["op7_decontaminate"]) == []


LONG = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, LONG), (2, "Solo"), (3, "the cat the cat the cat"), (4, None), (5, "?!"), (10, LONG), (6, "é Ü x")]
DOCS = [
    (1, f"zero {LONG.upper()}! zero"), (2, None), (3, ""), (4, "solo, solo; SOLO no"), (5, "the cat " * 5),
    (6, "two three four five six seven eight nine ten eleven one two"), (7, "É Ü x é Ü X"), (7, "solo"),
    (8, "one two three four five six seven eight nine"), (9, "x " * 30000 + LONG), (9, "x " * 30000 + LONG),
    (11, "one-two_three\x00four\x7ffive six seven eight nine ten\x85 eleven twelve"),
]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(*d, "x", 1) for d in DOCS], "doc_id long, text string, pos string, item_id int")
    return docs, spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("rows", [decontaminate.BROADCAST_ROWS, 0])
def test_odd_rows(spark, tables, rows, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", rows)
    got = sorted(map(tuple, decontaminate.contamination(*tables).collect()))
    assert got == sorted(brute(DOCS, ITEMS))


def test_null_id_and_empty_tables(spark, tables):
    docs, items = tables
    odd = spark.createDataFrame([(None, "solo a"), (None, "b")], "doc_id long, text string")
    got = sorted((r.n_words, r.n_hit) for r in decontaminate.contamination(odd, items).collect())
    assert got == [(1, 0), (2, 1)]
    assert decontaminate.contamination(docs.limit(0), items).count() == 0
    clean = decontaminate.contamination(docs, items.limit(0)).collect()
    assert len(clean) == len(DOCS) and not any(r.contaminated for r in clean)


def test_dropped_rows(spark, tables):
    kept = decontaminate.drop_contaminated(*tables)
    assert kept.columns == tables[0].columns
    clean = [d[0] for d, b in zip(DOCS, brute(DOCS, ITEMS)) if not b[-1]]
    assert sorted(r.doc_id for r in kept.collect()) == sorted(clean)


def test_proximity(spark, tables):
    _, items = tables
    edited = LONG.replace("six", "six inserted")
    docs = spark.createDataFrame([(1, edited), (2, "one two other words here")], "doc_id long, text string")
    terms = decontaminate.item_terms(items)
    index = decontaminate.build_index(docs, terms, fresh_path(spark, "postings"))
    near = decontaminate.proximity_matches(index, terms, slop=2).collect()
    assert {r.row.id for r in near} == {1} and {r.found for r in near} == {10}
