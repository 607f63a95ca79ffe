"""Alignment of two tokenizers against plain encoding and plain loops."""

import hashlib
from collections import Counter
from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from chatterlake.llm import alignment, queries
from chatterlake.llm.tokens import byte_alphabet, tokenizer_path

SMALL = "/root/testdata/sf0.001"
PATHS = (tokenizer_path(), tokenizer_path(alignment.PIECES))
plain_a = Tokenizer.from_file(PATHS[0])
plain_a.encode_special_tokens = True
plain_b = SentencePieceProcessor(model_file=PATHS[1])
BYTES = {c: i for i, c in enumerate(byte_alphabet())}


def tokens(text):
    """(ids, bytes) of both sides by the libraries."""
    a = plain_a.encode(" " + text, add_special_tokens=False)
    b = plain_b.encode(text)
    piece = lambda i: bytes([int(plain_b.id_to_piece(i)[3:5], 16)]) if plain_b.is_byte(i) else \
        plain_b.id_to_piece(i).replace("▁", " ").encode()
    return [(i, bytes(BYTES[c] for c in plain_a.id_to_token(i))) for i in a.ids], [(i, piece(i)) for i in b]


def by_hand(text):
    """(n_a, n_b, groups text, links) of one text."""
    if not text:
        return 0, 0, None, []
    sides = tokens(text)
    raw = (" " + text).encode()
    if any(b"".join(x for _, x in side) != raw for side in sides):
        return 0, 0, None, []
    spans = []
    for side in sides:
        at, out = 0, []
        for i, x in side:
            out.append((i, at, at + len(x)))
            at += len(x)
        spans.append(out)
    shared = sorted({e for _, _, e in spans[0]} & {e for _, _, e in spans[1]})
    parts, start = [], 0
    for end in shared:
        parts.append("|".join(",".join(str(i) for i, s, e in side if start <= s and e <= end) for side in spans))
        start = end
    links, j = [], 0
    for i, s, e in spans[0]:
        while spans[1][j][2] <= s:
            j += 1
        k = j
        while k < len(spans[1]) and spans[1][k][1] < e:
            links.append((i, spans[1][k][0]))
            k += 1
    return len(spans[0]), len(spans[1]), ";".join(parts), links


def expected(rows):
    found = [(doc_id, *by_hand(text)) for doc_id, text in rows]
    counts = Counter(p for *_, links in found for p in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((doc_id, n_a, n_b, 0 if g is None else g.count(";") + 1, len(links),
                    sum(counts[p] == best[p[1]] for p in links), sum(counts[p] for p in links),
                    "" if g is None else hashlib.sha256(g.encode()).hexdigest())
                   for doc_id, n_a, n_b, g, links in found), key=str)


def run_of(text):
    sides = alignment.byte_level_side(PATHS[0]), alignment.piece_side(PATHS[1])
    return alignment._run([" " + text], sides)


odd_text = st.lists(st.one_of(
    st.text(st.characters(exclude_categories=["Cs"]), max_size=12),
    st.sampled_from(["Word", " ", "  ", "   ", "\n", "\t", "'s", "12", "é", "日本", "<|endoftext|>", "<s>", "<0x41>", "▁", "�", "ﬁ"])),
    max_size=8).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(odd_text, min_size=1, max_size=4))
def test_tokens_and_soundness_of_any_text(texts):
    sides = alignment.byte_level_side(PATHS[0]), alignment.piece_side(PATHS[1])
    run, sound, ends, n_a, n_b = alignment._run([" " + t if t else "" for t in texts], sides)
    for t, ok, a, b in zip(texts, sound, n_a, n_b):
        hand = by_hand(t)
        assert bool(ok) == (hand[2] is not None) and (a, b) == hand[:2]
    kept = [t for t, ok in zip(texts, sound) if ok]
    assert run.a.tolist() == [i for t in kept for i, _ in tokens(t)[0]]
    assert run.b.tolist() == [i for t in kept for i, _ in tokens(t)[1]]


@settings(max_examples=200, deadline=None)
@given(odd_text.filter(lambda t: by_hand(t)[2] is not None), st.lists(st.integers(0, 60), max_size=6), st.randoms())
def test_fragments_compose_in_any_order(text, cuts, rng):
    run = run_of(text)[0]
    edges = [-1, *sorted(set(cuts)), 10 ** 9]
    parts = [alignment.fragment(run.cut(a, b)) for a, b in zip(edges, edges[1:])]
    left = alignment.finished(reduce(alignment.compose, parts))
    while len(parts) > 1:  # compose neighbours in a random order
        i = rng.randrange(len(parts) - 1)
        parts[i:i + 2] = [alignment.compose(*parts[i:i + 2])]
    n_a, n_b, groups, links = by_hand(text)
    for whole in (left, alignment.finished(parts[0])):
        assert whole.text.decode() == groups + ";" and whole.n_groups == groups.count(";") + 1
        assert whole.links.tolist() == [a << 32 | b for a, b in links]
        assert len(whole.links) == n_a + n_b - whole.n_groups


ODD = [(1, "Plain words, and more."), (1, "Plain words, and more."), (2, None), (3, ""), (None, "no id ’quoted’ naïve"),
       (4, " "), (5, "   two  three   "), (6, "bad ▁ sign"), (7, "long words " * 900 + "x" * 3000 + " end"), (8, "日本語 <s> <|endoftext|>\n\n"),
       (9, "x" * 4000), (10, "a ▁ " * 1000), (11, " " * 2500 + "b")]


@pytest.mark.parametrize("range_chars,block_links", [(alignment.RANGE_CHARS, alignment.BLOCK_LINKS), (300, 50)])
def test_odd_rows(spark, range_chars, block_links):
    df = (spark.createDataFrame(ODD, "doc_id long, text string").repartition(3).withColumn("pair", F.lit("x"))
          .withColumn("block", F.lit(1)).withColumn("row", F.lit(2)).withColumn("links", F.lit(3)))
    got = alignment.align(df, range_chars=range_chars, block_links=block_links).collect()
    assert sorted(map(tuple, got), key=str) == expected(ODD)


def test_empty_table(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").limit(0)
    assert alignment.align(df).count() == 0


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    got = queries.QUERIES["op12_alignment"](spark, SMALL).collect()
    assert sorted(map(tuple, got), key=str) == expected(list(map(tuple, docs)))


def test_digits():
    table, width = alignment._digits(1001)
    for n in (0, 9, 10, 99, 100, 1000):
        assert bytes(table[n][:width[n]]).decode() == str(n)
    assert np.all(width == [len(str(n)) for n in range(1001)])
