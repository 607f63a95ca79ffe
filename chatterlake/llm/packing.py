"""Packing by Karmarkar-Karp multiway differencing.

A document's ids are cut at multiples of the window size; whole windows stand alone. The
remainders of one task are cut once more at ``grain`` and collected in groups of at least ``group``
tokens, or of ``pieces`` pieces where documents are shorter than ``group / pieces`` tokens,
and each group is divided over the fewest windows that could hold it. Largest differencing does
the division: every piece starts as a partition with one loaded window, and the two partitions with
the largest imbalance are merged with opposing order, fullest window upon emptiest, until one is
left. If its fullest window exceeds the capacity, the number of windows rises and the division is
repeated. A group is bounded, and so is the memory of a task; nothing is shuffled. Windows are
numbered within their task, so a task that is run again gives the same numbers.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import count

from pyspark.sql import DataFrame

from chatterlake.llm.tokens import ID_BYTES, encode_batches, tokenizer_path

CAPACITY = 1024
GROUP = 65_536  # tokens
PIECES = 16_384  # whole windows even of pieces of one token
GRAIN = 512
TASK_BITS = 33  # windows of a task are numbered below 2 ** TASK_BITS

_SCHEMA = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, "
           "sequence_id bigint, offset bigint")


def differencing(lengths: list[int], k: int) -> list[list[int]]:
    """Indices of ``lengths`` in ``k`` windows of near-equal sums, fullest window first.

    A partition lists only its loaded windows, in falling order of their sums; the others are
    empty. Ties go by position, so the result is a function of the arguments.
    """
    serial = count()
    heap = [(-n, next(serial), [n], [[i]]) for i, n in enumerate(lengths)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, _, sums, bins = heapq.heappop(heap)
        _, _, other, more = heapq.heappop(heap)
        gap = k - len(other)  # window i of the one meets window k - 1 - i of the other
        merged = list(zip(sums[:gap], bins[:gap]))
        for i in range(gap, len(sums)):
            j = k - 1 - i
            merged.append((sums[i] + other[j], bins[i] + more[j]))
        for j in range(max(0, k - len(sums))):
            if j < len(other):
                merged.append((other[j], more[j]))
        merged.sort(key=lambda x: -x[0])
        least = merged[-1][0] if len(merged) == k else 0
        heapq.heappush(heap, (least - merged[0][0], next(serial), [s for s, _ in merged],
                              [b for _, b in merged]))
    return heap[0][3] if heap else []


def windows(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """The division over the fewest windows, raised until every window is within ``capacity``."""
    k = max(1, -(-sum(lengths) // capacity))
    while True:
        bins = differencing(lengths, k)
        if all(sum(lengths[i] for i in b) <= capacity for b in bins):
            return bins
        k += 1


def _pack(rows: Iterator, path: str, capacity: int, group: int, pieces: int, grain: int) -> Iterator:
    import pyarrow as pa
    from pyspark import TaskContext

    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    first = TaskContext.get().partitionId() << TASK_BITS
    serial = count(first)
    out: list[tuple] = []
    held: list[tuple] = []  # remainders of the group that is being filled
    tokens = waiting = 0

    def batch():
        done = pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
        out.clear()
        return done

    def divide():
        nonlocal waiting
        for members in windows([x[2] for x in held], capacity):
            sequence, offset = next(serial), 0
            for i in members:
                out.append((*held[i], sequence, offset))
                offset += held[i][2]
        held.clear()
        waiting = 0

    for doc_id, ids in encode_batches(rows, path):
        n = len(ids) // ID_BYTES
        tail = n - n % capacity
        for a in range(0, tail, capacity):
            piece = ids[a * ID_BYTES:(a + capacity) * ID_BYTES]
            out.append((doc_id, a, capacity, piece, n, next(serial), 0))
        for a in range(tail, n, grain):
            b = min(a + grain, n)
            held.append((doc_id, a, b - a, ids[a * ID_BYTES:b * ID_BYTES], n))
        tokens, waiting = tokens + n, waiting + n - tail
        if waiting >= group or len(held) >= pieces:
            divide()
        if out and (tokens >= 2_000_000 or len(out) >= 2 * pieces):
            tokens = 0
            yield batch()
    divide()
    if out:
        yield batch()


def pack(docs: DataFrame, text: str = "text", tokenizer: str | None = None,
         capacity: int = CAPACITY, group: int = GROUP, pieces: int = PIECES, grain: int = GRAIN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, sequence_id, offset.

    ``ids`` holds little-endian unsigned 32-bit token ids; each document ends with id 0, so a
    null or empty text is one piece of one token. Repeated rows are packed as often as they occur,
    under their doc_id; a null doc_id stays null. Other columns are ignored. An empty table
    gives no pieces. ``tokenizer`` is the path of a tokenizers file on every executor.
    """
    path = tokenizer or tokenizer_path()

    def run(rows):
        return _pack(rows, path, capacity, group, pieces, grain)

    return docs.select("doc_id", text).mapInArrow(run, _SCHEMA)
