"""Token shards as wavelet matrices.

Documents are range-partitioned by doc_id, encoded in that order and gathered into shards of
about ``shard_tokens`` tokens. A shard is one compressed binary file: the alphabet of its tokens,
bit-planes of their ranks in it from the highest bit to the lowest, each a stable partition of the one
before, with a directory of counts, plus the ids and lengths of its documents. Access, counting (rank) and occurrence lookup (select) work on the planes
without rebuilding the ids. The files travel as the ``payload`` of a Parquet table, so Spark's commit
protocol, and not a task, decides which of them exist after an executor is lost.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatterlake.llm.common import arrow_rows
from chatterlake.llm.tokens import ID_BYTES, encode_batches, tokenizer_path

SHARD_TOKENS = 1 << 17
MAGIC = b"WMX1"
_HEAD = struct.Struct("<4sBQQI")  # magic, planes, tokens, documents, symbols
_PART = struct.Struct("<QII")  # zeros of a plane, bytes of its bits, bytes of its directory
_SHARDS = ("part bigint, shard bigint, first_doc_id bigint, n_docs bigint, n_tokens bigint, "
           "start_in_part bigint, payload binary")
_DOCS = "doc_id bigint, start bigint, n_tokens bigint, ids binary"


class _Plane:
    """Bits in 64-bit words with the count of ones before each word."""

    def __init__(self, words: np.ndarray, n: int, zeros: int, before: np.ndarray | None = None):
        self.words, self.n, self.zeros = words, n, zeros
        if before is None:
            ones = np.bitwise_count(words).astype(np.uint64)
            before = np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)
        self.before = before

    def bit(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones among the first ``i`` bits."""
        word = np.minimum(i >> 6, len(self.words) - 1)
        left = (i - (word << 6)).astype(np.uint64)
        mask = np.where(left >= 64, ~np.uint64(0), (np.uint64(1) << (left & np.uint64(63))) - np.uint64(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & mask)

    def select(self, j: np.ndarray, one: bool) -> np.ndarray:
        """Position of the ``j``-th (from 0) one or zero."""
        before = self.before.astype(np.int64)
        if not one:
            before = (np.arange(len(before)) << 6) - before
        word = np.searchsorted(before, j, side="right") - 1
        bits = np.unpackbits(self.words[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        seen = np.cumsum(bits == one, axis=1)
        return (word << 6) + np.argmax(seen > (j - before[word])[:, None], axis=1)

    def unpacked(self) -> np.ndarray:
        return np.unpackbits(self.words.view(np.uint8), count=self.n, bitorder="little").view(bool)


class WaveletMatrix:
    """A sequence over a sorted alphabet; the planes hold ranks in it."""

    def __init__(self, planes: list[_Plane], n: int, alphabet: np.ndarray):
        self.planes, self.n, self.alphabet = planes, n, alphabet

    def __len__(self) -> int:
        return self.n

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        used = np.bincount(ids) > 0
        alphabet = np.flatnonzero(used).astype(np.uint32)
        width = max(1, (len(alphabet) - 1).bit_length())
        kind = np.uint16 if width <= 16 else np.uint32
        sequence = (np.cumsum(used) - 1).astype(kind)[ids]
        planes = []
        for level in range(width - 1, -1, -1):
            bits = (sequence & kind(1 << level)) != 0
            packed = np.packbits(bits, bitorder="little").tobytes()
            words = np.frombuffer(packed + bytes(-len(packed) % 8 or 8 * (not packed)), np.uint64)
            zeros, ones = np.flatnonzero(~bits), np.flatnonzero(bits)
            planes.append(_Plane(words, n, len(zeros)))
            sequence = np.concatenate([sequence.take(zeros), sequence.take(ones)])
        return cls(planes, n, alphabet)

    def symbols(self) -> np.ndarray:
        """The whole sequence: from the lowest plane up, each partition is undone."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level, plane in enumerate(reversed(self.planes)):
            bits = plane.unpacked()
            above = np.empty_like(out)
            above[np.flatnonzero(~bits)] = out[:plane.zeros]
            above[np.flatnonzero(bits)] = out[plane.zeros:] | out.dtype.type(1 << level)
            out = above
        return self.alphabet[out] if self.n else out

    def access(self, positions) -> np.ndarray:
        """Symbols at the given positions."""
        i = np.asarray(positions, np.int64)
        out = np.zeros(len(i), np.int64)
        for plane in self.planes:
            bit = plane.bit(i).astype(bool)
            ones = plane.ones(i)
            i = np.where(bit, plane.zeros + ones, i - ones)
            out = (out << 1) | bit
        return self.alphabet[out].astype(np.int64) if len(i) else out

    def _rank(self, symbol: int) -> int:
        """Rank of a symbol in the alphabet, -1 if it does not occur."""
        r = int(np.searchsorted(self.alphabet, symbol))
        return r if symbol >= 0 and r < len(self.alphabet) and self.alphabet[r] == symbol else -1

    def _range(self, symbol: int, lo: int, hi: int) -> tuple[int, int]:
        symbol = self._rank(symbol)
        if symbol < 0:
            return 0, 0
        edge = np.array([lo, hi], np.int64)
        for k, plane in enumerate(self.planes):
            ones = plane.ones(edge)
            edge = plane.zeros + ones if symbol >> (len(self.planes) - 1 - k) & 1 else edge - ones
        return int(edge[0]), int(edge[1])

    def rank_many(self, symbols: np.ndarray, positions: np.ndarray) -> np.ndarray:
        """For each pair, how often the symbol stands before the position; symbols must occur."""
        rank = np.searchsorted(self.alphabet, symbols)
        edge, start = np.asarray(positions, np.int64), np.zeros(len(rank), np.int64)
        for k, plane in enumerate(self.planes):
            one = (rank >> (len(self.planes) - 1 - k) & 1).astype(bool)
            ends, starts = plane.ones(edge), plane.ones(start)
            edge = np.where(one, plane.zeros + ends, edge - ends)
            start = np.where(one, plane.zeros + starts, start - starts)
        return edge - start

    def count(self, symbol: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences of a symbol in [lo, hi)."""
        a, b = self._range(symbol, lo, self.n if hi is None else hi)
        return b - a

    def occurrences(self, symbol: int) -> np.ndarray:
        """All positions of a symbol, ascending."""
        a, b = self._range(symbol, 0, self.n)
        i, symbol = np.arange(a, b, dtype=np.int64), self._rank(symbol)
        for k, plane in enumerate(reversed(self.planes)):
            one = bool(symbol >> k & 1)
            i = plane.select(i - plane.zeros if one else i, one) if len(i) else i
        return i


def pack_shard(ids: np.ndarray, doc_ids: list, lengths: list[int]) -> bytes:
    """The file of one shard."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1).compress
    matrix = WaveletMatrix.build(ids)
    out = [_HEAD.pack(MAGIC, len(matrix.planes), len(ids), len(doc_ids), len(matrix.alphabet))]
    known = np.array([x is not None for x in doc_ids], np.uint8)
    table = press(np.array([x or 0 for x in doc_ids], "<i8").tobytes() + known.tobytes()
                  + np.array(lengths, "<i8").tobytes() + matrix.alphabet.astype("<u4").tobytes())
    out += [struct.pack("<I", len(table)), table]
    for plane in matrix.planes:
        bits, ranks = press(plane.words.tobytes()), press(plane.before[::8].tobytes())
        out += [_PART.pack(plane.zeros, len(bits), len(ranks)), bits, ranks]
    return b"".join(out)


def open_shard(data: bytes | memoryview) -> tuple[WaveletMatrix, list, np.ndarray]:
    """The matrix of a shard file, the ids of its documents and their lengths.

    The directory in the file holds every eighth rank; the ranks between are counted from the words.
    """
    import zstandard

    expand = zstandard.ZstdDecompressor().decompress
    magic, width, n, n_docs, n_symbols = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a wavelet shard")
    at = _HEAD.size
    (size,) = struct.unpack_from("<I", data, at)
    table = expand(data[at + 4:at + 4 + size])
    at += 4 + size
    planes = []
    for _ in range(width):
        zeros, bits, ranks = _PART.unpack_from(data, at)
        at += _PART.size
        words = np.frombuffer(expand(data[at:at + bits]), np.uint64)
        coarse = np.frombuffer(expand(data[at + bits:at + bits + ranks]), np.uint32)
        at += bits + ranks
        ones = np.zeros(-(-(len(words) + 1) // 8) * 8, np.uint32)
        ones[1:len(words) + 1] = np.bitwise_count(words)
        inner = ones.reshape(-1, 8).copy()
        inner[:, 0] = 0
        before = (coarse[:, None] + np.cumsum(inner, axis=1, dtype=np.uint32)).ravel()[:len(words) + 1]
        planes.append(_Plane(words, n, zeros, before))
    doc_ids = np.frombuffer(table, "<i8", n_docs).tolist()
    known = np.frombuffer(table, np.uint8, n_docs, 8 * n_docs)
    lengths = np.frombuffer(table, "<i8", n_docs, 9 * n_docs)
    alphabet = np.frombuffer(table, "<u4", n_symbols, 17 * n_docs)
    return WaveletMatrix(planes, n, alphabet), [d if k else None for d, k in zip(doc_ids, known)], lengths


def _shards(rows: Iterator, path: str, shard_tokens: int) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    part, serial, start = TaskContext.get().partitionId(), 0, 0
    doc_ids: list = []
    held: list[np.ndarray] = []
    size = 0

    def shard():
        ids = np.concatenate(held)
        return pa.RecordBatch.from_arrays([
            pa.array([part], pa.int64()), pa.array([serial], pa.int64()),
            pa.array(doc_ids[:1], pa.int64()), pa.array([len(doc_ids)], pa.int64()),
            pa.array([size], pa.int64()), pa.array([start], pa.int64()),
            pa.array([pack_shard(ids, doc_ids, [len(x) for x in held])], pa.binary()),
        ], names=["part", "shard", "first_doc_id", "n_docs", "n_tokens", "start_in_part", "payload"])

    for doc_id, ids in encode_batches(rows, path):
        doc_ids.append(doc_id)
        held.append(np.frombuffer(ids, "<u4"))
        size += len(held[-1])
        if size >= shard_tokens:
            yield shard()
            serial, start, size = serial + 1, start + size, 0
            doc_ids, held = [], []
    if doc_ids:
        yield shard()


def write_shards(docs: DataFrame, path: str, text: str = "text", tokenizer: str | None = None,
                 shard_tokens: int = SHARD_TOKENS) -> None:
    """Write the shards of ``docs`` in ascending doc_id order.

    A null or empty text is its end id alone. Null doc_ids come first; repeated doc_ids stay
    separate documents, in the order of their texts. Other columns are ignored. An empty table
    writes no shard. A shard closes with the document that fills it, so it holds at most
    ``shard_tokens`` plus the ids of one document.
    """
    file = tokenizer or tokenizer_path()

    def run(rows):
        return _shards(rows, file, shard_tokens)

    shards = (docs.select("doc_id", text).repartitionByRange("doc_id")
              .sortWithinPartitions("doc_id", text).mapInArrow(run, _SHARDS))
    with arrow_rows(docs.sparkSession, 1000):
        shards.write.mode("overwrite").option("compression", "none").parquet(path)


def _cut_ids(ids: np.ndarray, ends: np.ndarray):
    """The ids as an Arrow array of one binary a document, on their own memory.

    Arrow never lets go of the memory behind a memoryview that ``pa.array`` was given.
    """
    import pyarrow as pa

    offsets = ID_BYTES * np.append(0, ends)
    if offsets[-1] > np.iinfo(np.int32).max:
        raise ValueError("the documents of a shard hold more than 2 GB of ids")
    return pa.Array.from_buffers(
        pa.binary(), len(ends), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids.astype("<u4", copy=False))])


def _documents(rows: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in rows:
        for first, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
            matrix, doc_ids, lengths = open_shard(memoryview(payload.as_buffer()))
            ends = np.cumsum(lengths)
            starts = ends - lengths
            yield pa.RecordBatch.from_arrays([
                pa.array(doc_ids, pa.int64()), pa.array(starts + first, pa.int64()),
                pa.array(lengths, pa.int64()), _cut_ids(matrix.symbols(), ends),
            ], names=["doc_id", "start", "n_tokens", "ids"])
    pa.default_memory_pool().release_unused()


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """Documents of written shards: doc_id, start (ids of all documents before), n_tokens, ids.

    The starts are a running sum over one row per writing task; that table is as long as the
    write had tasks.
    """
    shards = spark.read.schema(_SHARDS).parquet(path)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = (shards.groupBy("part").agg(F.sum("n_tokens").alias("n"))
             .select("part", F.coalesce(before, F.lit(0)).alias("before_part")))
    return (
        shards.join(F.broadcast(parts), "part")
        .select((F.col("before_part") + F.col("start_in_part")).alias("start"), "payload")
        .mapInArrow(_documents, _DOCS)
    )


def symbol_counts(spark: SparkSession, path: str, symbols: list[int]) -> DataFrame:
    """Occurrences of the given ids per shard (part, shard, symbol, n), counted on the planes."""

    def run(rows):
        import pyarrow as pa

        for batch in rows:
            for part, shard, payload in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2)):
                matrix = open_shard(memoryview(payload.as_buffer()))[0]
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(symbols), pa.int64()),
                    pa.array([shard] * len(symbols), pa.int64()),
                    pa.array(symbols, pa.int64()),
                    pa.array([matrix.count(s) for s in symbols], pa.int64()),
                ], names=["part", "shard", "symbol", "n"])

    return (spark.read.schema(_SHARDS).parquet(path).select("part", "shard", "payload")
            .mapInArrow(run, "part bigint, shard bigint, symbol bigint, n bigint"))
