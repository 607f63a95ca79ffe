"""Removed words against brute force, and the FM-index by itself."""

import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chatterlake.llm import queries, substring_dedup
from chatterlake.storage import shared_root

SMALL = "/root/testdata/sf0.001"


def brute(docs, window=50):
    """{(doc_id, position in docs): (n_words, n_removed, sha256)}; a null id is the largest."""
    first: dict = {}
    split = [(i if i is not None else 1 << 63, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    for i, w in split:
        for a in range(len(w) - window + 1):
            key = tuple(w[a:a + window])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in split:
        gone = set()
        for a in range(len(w) - window + 1):
            if first[tuple(w[a:a + window])] < i:
                gone |= set(range(a, a + window))
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id if r.doc_id is not None else 1 << 63, r.n_words, r.n_removed, r.kept_sha256)
                  for r in df.collect())


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    expected = brute(docs)
    assert rows_of(queries.QUERIES["op6_substring_dedup"](spark, SMALL)) == expected
    assert sum(r[2] for r in expected) > 0


@pytest.mark.parametrize("hot", [1000, 3])
def test_made_passages(spark, hot):
    rnd = random.Random(5)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [[rnd.choice(vocabulary) for _ in range(rnd.choice([50, 51, 60, 120]))] for _ in range(6)]
    docs: list = [(None, " ".join(passages[0])), (3, None), (4, ""), (5, "short text"), (5, "short text")]
    for i in range(60):
        words: list = []
        for _ in range(rnd.randint(1, 4)):
            words += [rnd.choice(vocabulary) for _ in range(rnd.randint(0, 70))]
            part = list(rnd.choice(passages))
            if rnd.random() < 0.3:
                part[rnd.randrange(len(part))] = "edited"
            words += part[rnd.choice([0, 0, 5]):]
        docs.append((rnd.randint(10, 60), rnd.choice([" ", "\n", "  "]).join(words)))
        if rnd.random() < 0.2:
            docs.append((rnd.randint(10, 60), docs[-1][1]))
    docs.append((7, "x " * 20000))
    docs.append((8, "y x " + "x " * 100))
    table = spark.createDataFrame([(*d, "c") for d in docs], "doc_id long, text string, words string").repartition(5)
    assert rows_of(substring_dedup.remove_repeats(table, hot=hot, shard_words=500)) == brute(docs)
    assert substring_dedup.remove_repeats(table.limit(0)).count() == 0


def test_few_files(spark):
    """Tables of numbers had a file for each shuffle partition, and three more tables were stored."""
    rnd = random.Random(7)
    passages = [[f"w{rnd.randrange(90)}" for _ in range(80)] for _ in range(8)]
    docs = []
    for i in range(400):
        part = list(rnd.choice(passages))
        part[rnd.randrange(80)] = f"edit{i % 9}"
        docs.append((i, " ".join([f"d{i}", *part, *rnd.choice(passages)])))
    settings_ = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings_}
    stored = set(Path(shared_root(spark)).rglob("part-*.parquet"))
    try:
        for k, v in settings_.items():
            spark.conf.set(k, v)
        assert rows_of(substring_dedup.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), hot=20)) == brute(docs)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = [p for p in Path(shared_root(spark)).rglob("part-*.parquet") if p not in stored]
    assert len(files) < 200  # over 300 before


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=4, max_size=14), min_size=1, max_size=7), st.data())
def test_index_finds_windows_of_smaller_owners(sequences, data):
    owners = np.array([data.draw(st.integers(0, 3)) for _ in sequences])
    got = substring_dedup.repeated_windows([np.array(s) for s in sequences], owners, 4)
    for s, owner, hit in zip(sequences, owners, got):
        assert hit.tolist() == [
            any(s[a:a + 4] == other[b:b + 4] for other, o in zip(sequences, owners) if o < owner
                for b in range(len(other) - 3)) for a in range(len(s) - 3)]


@pytest.mark.parametrize("text", ["", " \t", "a", "  ab\x0bé\x85 c\n\nab ", "x" * 50 + " y"])
def test_word_hashes_by_words(text, monkeypatch):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert substring_dedup.split_words(text) == [w.encode() for w in words]
    whole = substring_dedup.word_hashes(text)
    assert len(whole) == len(words)
    assert [whole[i] == whole[j] for i in range(len(words)) for j in range(len(words))] == [
        a == b for a in words for b in words]
    monkeypatch.setattr(substring_dedup, "_BLOCK", 3)
    assert substring_dedup.word_hashes(text).tolist() == whole.tolist()


def test_stretches_are_cut():
    first, last = substring_dedup.stretches(np.array([7, 7, 7, 7, 7, 1, 7]), 2)
    assert first.tolist() == [0, 2, 4, 5, 6] and last.tolist() == [1, 3, 4, 5, 6]
    assert substring_dedup.stretches(np.zeros(0, np.int64), 2)[0].tolist() == []
