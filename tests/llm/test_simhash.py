"""Fingerprints, the vantage-point join and components against brute force."""

import random
import re

import numpy as np
import pytest
import xxhash

from chatterlake.llm import queries, simhash
from chatterlake.llm.components import components

SMALL = "/root/testdata/sf0.001"


def slow_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    """{doc_id: smallest doc_id reachable}."""
    ids = sorted(fps)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and bin(fps[x] ^ fps[y]).count("1") <= 4:
                a, b = sorted((find(x), find(y)))
                parent[b] = a
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, "  \n", "One", "one two three", "A b c d", "É É é é x", "a b c d " * 9,
                                  "x\x1cy\x85z w\x0bv u"])
def test_fingerprint_by_definition(text):
    assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    fps = {d.doc_id: slow_fingerprint(d.text) for d in docs}
    expected = slow_components(fps)
    got = queries.QUERIES["op8_simhash"](spark, SMALL).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{fps[i]:016x}", expected[i]) for i in fps}
    assert len(got) == len(docs) and len(set(expected.values())) < len(docs)


@pytest.mark.parametrize("shard_size", [40, 1 << 17])
def test_links_of_clusters_and_noise(spark, shard_size):
    rnd = random.Random(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        seed = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 30])):
            fps.add(seed)
            for _ in range(rnd.choice([1, 3, 4, 5])):
                seed ^= 1 << rnd.randrange(64)
    ordered = dict(enumerate(sorted(fps)))
    table = spark.createDataFrame([(np.uint64(f).astype(np.int64).item(),) for f in fps], "fp long")
    found = {r.node: r.component for r in components(simhash.links(table, 4, shard_size)).collect()}
    signed = {i: np.uint64(f).astype(np.int64).item() for i, f in ordered.items()}
    slow = slow_components(ordered)
    mine: dict = {}
    theirs: dict = {}
    for i, s in signed.items():
        mine.setdefault(found.get(s, s), set()).add(i)
        theirs.setdefault(slow[i], set()).add(i)
    assert set(map(frozenset, mine.values())) == set(map(frozenset, theirs.values()))


def test_odd_rows(spark):
    rows = [(5, None, 1), (2, "", 1), (None, "a b c d e", 1), (7, "A b  c d e", 1), (7, "A b  c d e", 1), (9, "z" * 90000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(5, 2), (2, 2), (None, 7), (7, 7), (7, 7), (9, 9)], key=repr)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [2, 7, 7, 9]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i + 1, i) for i in range(100, 200)] + [(7, 5), (5, 7)], "a long, b long")
    got = {r.node: r.component for r in components(chain).collect()}
    assert got == {i: 100 for i in range(100, 201)} | {5: 5, 7: 5}
