"""Token caching, wavelet shards and packing against the plain tokenizer."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from chatterlake.llm import packing, queries, tokens, wavelet
from chatterlake.llm.tokens import Encoder, tokenizer_path

SMALL = "/root/testdata/sf0.001"
plain = Tokenizer.from_file(tokenizer_path())
words = Encoder(tokenizer_path(), max_words=50)
literal = Tokenizer.from_file(tokenizer_path())
literal.encode_special_tokens = True
literal_words = Encoder(tokenizer_path(), plain_specials=True)


def encoded(encoder, texts):
    ids, ends = encoder.encode(texts)
    return [part.tolist() for part in np.split(ids, ends[:-1])]


def ids_of(text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, 0]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "Word", " ", "  ", "\n", "\t", "'s", "12", "é", "!", "\x1c", "\x85",
                                 " ", "<|endoftext|>", "日本"]), max_size=14).map("".join))
def test_cached_ids_are_plain_ids(text):
    assert encoded(words, [text]) == [ids_of(text)[:-1]]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=5))
def test_ids_of_any_unicode_are_plain_ids(texts):
    assert encoded(words, texts) == [ids_of(t)[:-1] for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(
    st.sampled_from(["a", "Word", " ", "  ", "\n", "'", "'s", "'ll", "'l", "'re", "12", "\x85", "\xa0", "\u3000", "日", "\U0001f600"]),
    st.text(st.characters(exclude_categories=["Cs", "Cn"]), max_size=3)), max_size=9).map("".join), max_size=4))
def test_texts_are_cut_as_the_library_cuts_them(texts):
    # texts were cut one by one by a pattern, into a string a word
    column = pa.array(["left out", *texts])[1:]
    cut, counts, unassigned = tokens._cut(column)
    expected = [[w for w, _ in plain.pre_tokenizer.pre_tokenize_str(t)] for t in texts]
    alphabet = tokens.byte_alphabet()
    assert ["".join(alphabet[b] for b in w) for w in cut.to_pylist()] == [w for t in expected for w in t]
    assert counts.tolist() == [len(t) for t in expected] and not len(unassigned)


def test_new_words_go_to_the_library_in_bulk():
    # it was called once for every new word
    class Counting:
        calls = 0

        def __getattr__(self, name):
            Counting.calls += 1
            return getattr(model, name)

    encoder = Encoder(tokenizer_path())
    model, encoder._model = encoder._model, Counting()
    texts = [" ".join(f"w{chr(97 + i % 26)}{i:x}z" for i in range(a, a + 100)) for a in range(0, 5000, 100)]
    assert encoded(encoder, texts) == [ids_of(t)[:-1] for t in texts]
    assert 0 < Counting.calls < 10


def test_words_in_several_lots(monkeypatch):
    monkeypatch.setattr(tokens, "LEARNT", 3)
    texts = ["one two  three's", "", "日本 \U0001f600 x", "a b c d e f g h", "<|endoftext|> y"]
    assert encoded(Encoder(tokenizer_path()), texts) == [ids_of(t)[:-1] for t in texts]


@pytest.mark.parametrize("block_bytes", [1, 7, 1000])
def test_batches_are_encoded_in_blocks(block_bytes):
    texts = ["one two", None, "", "", "日本 text", None, "x" * 50, "'s"]
    batch = pa.record_batch([pa.array(range(9)), pa.array(["before", *texts])], names=["doc_id", "text"])[1:]
    empty = batch[:0]
    got = list(tokens.encode_batches([empty, batch, empty], tokenizer_path(), block_bytes))
    assert [d for d, _ in got] == list(range(1, 9))
    assert [np.frombuffer(ids, "<u4").tolist() for _, ids in got] == [ids_of(t) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["a", " ", "<|endoftext|>", "日本", "<|", "\n"]), max_size=9).map("".join))
def test_special_strings_can_be_plain_text(text):
    assert encoded(literal_words, [text, ""]) == [literal.encode(text, add_special_tokens=False).ids, []]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=400))
def test_matrix_answers_as_the_list(symbols):
    data = wavelet.pack_shard(np.array(symbols, np.uint32), [5], [len(symbols)])
    matrix, docs, lengths = wavelet.open_shard(data)
    assert matrix.symbols().tolist() == symbols and docs == [5] and lengths.tolist() == [len(symbols)]
    assert matrix.access(range(len(symbols))).tolist() == symbols
    for s in [*set(symbols), 3]:
        assert matrix.occurrences(s).tolist() == [i for i, x in enumerate(symbols) if x == s]
        assert matrix.count(s, 1, 3) == symbols[1:3].count(s) if len(symbols) > 3 else True


ODD = [(3, "one two  three \n four"), (1, None), (2, ""), (None, "no id"), (3, "again " * 3000), (9, "x" * 5000)]


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    return (spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
            .withColumn("start", F.lit("clash")).withColumn("ids", F.lit(1)))


def test_shards_of_odd_rows(spark, odd, tmp_path):
    wavelet.write_shards(odd, str(tmp_path / "w"), shard_tokens=4)
    got = sorted(wavelet.read_shards(spark, str(tmp_path / "w")).collect(), key=lambda r: r.start)
    expected = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [r.doc_id for r in got] == [r[0] for r in expected]
    position = 0
    for row, (_, text) in zip(got, expected):
        assert (row.start, np.frombuffer(row.ids, "<u4").tolist()) == (position, ids_of(text))
        position += len(ids_of(text))
    counted = wavelet.symbol_counts(spark, str(tmp_path / "w"), [0]).groupBy().sum("n").first()[0]
    assert counted == sum(ids_of(t).count(0) for _, t in ODD)


def test_read_documents_are_let_go():
    """The memory behind documents read from shards was never freed."""
    import gc
    import tracemalloc

    payload = wavelet.pack_shard(np.arange(100_000, dtype=np.uint32), [1, None, 3], [60_000, 0, 40_000])
    shard = pa.RecordBatch.from_arrays([pa.array([7], pa.int64()), pa.array([payload], pa.binary())], ["start", "payload"])

    def read():
        (batch,) = wavelet._documents([shard])
        return batch.to_pydict()

    got = read()
    assert got["doc_id"] == [1, None, 3] and got["start"] == [7, 60_007, 60_007] and got["n_tokens"] == [60_000, 0, 40_000]
    assert b"".join(got["ids"]) == np.arange(100_000, dtype="<u4").tobytes() and got["ids"][1] == b""
    del got
    tracemalloc.start()
    for _ in range(5):
        read()
    gc.collect()
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 400_000  # the ids of one reading; five were held


def test_empty_tables(spark, odd, tmp_path):
    wavelet.write_shards(odd.limit(0), str(tmp_path / "w"))
    assert wavelet.read_shards(spark, str(tmp_path / "w")).count() == 0
    assert packing.pack(odd.limit(0)).count() == 0


def test_wavelet_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect()
    got = queries.QUERIES["op2_wavelet_shards"](spark, SMALL).orderBy("doc_id").collect()
    start = 0
    for d, r in zip(docs, got, strict=True):
        ids = ids_of(d.text)
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), crc(ids))
        start += len(ids)


def check_pieces(texts, pieces, key=lambda r: r.doc_id):
    sequences: dict = {}
    documents: dict = {}
    for r in pieces:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
        documents.setdefault(key(r), []).append(r)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    assert set(documents) == set(texts)
    for k, parts in documents.items():
        ids, at = ids_of(texts[k]), 0
        for r in sorted(parts, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == crc(ids[at:at + r.length])
            at += r.length
        assert at == len(ids)
    return sum(length for parts in sequences.values() for _, length in parts) / (1024 * len(sequences))


def test_packing_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    filled = check_pieces({d.doc_id: d.text for d in docs},
                          queries.QUERIES["op5_packing"](spark, SMALL).collect())
    assert filled > 0.97


@pytest.mark.parametrize("words", [0, 2, 8, 19])
def test_short_documents_fill_windows(spark, words):
    # groups of 128 texts were 12 to 83 % full
    texts = {i: " ".join(["a"] * words) for i in range(20_000)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    rows = packing.pack(docs).select("doc_id", "length", "sequence_id").collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    fills: dict = {}
    for r in rows:
        fills[r.sequence_id] = fills.get(r.sequence_id, 0) + r.length
    assert max(fills.values()) <= 1024 and sum(fills.values()) > 0.97 * 1024 * len(fills)


def test_packing_odd_rows(spark, odd):
    from pyspark.sql import functions as F

    pieces = packing.pack(odd).withColumn("ids_crc32", F.crc32("ids")).collect()
    texts = {(d, len(ids_of(t))): t for d, t in ODD}
    check_pieces(texts, pieces, key=lambda r: (r.doc_id, r.doc_tokens))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 1024), min_size=1, max_size=60))
def test_windows_hold_every_piece_once(lengths):
    bins = packing.windows(lengths)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 1024 for b in bins)


def test_differencing_by_hand():
    # 8,7,6,5,4 in two windows: 8-7=1 6-5=1 4-1=3 3-1=2: a difference of 2
    sums = [sum([8, 7, 6, 5, 4][i] for i in b) for b in packing.differencing([8, 7, 6, 5, 4], 2)]
    assert sorted(sums) == [14, 16]
