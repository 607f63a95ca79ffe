"""Alignment of two tokenizers over the same bytes.

The tokens of a byte range are a fragment: an open prefix (what stands before the first place where
tokens of both sides end), closed groups, and an open suffix. Fragments compose associatively: a suffix
and the prefix behind it close into one group. Documents are fragments whose two ends are known
to be shared. Short documents are cut into groups in the task that reads them; very long ones
are cut into byte ranges that are tokenised apart, and their fragments are composed in a tree, eight at a
time, so no task holds more than eight of them.

Within a group every stretch between neighbouring ends lies in one token of each side, which makes it
one link. Links are kept as numbers into the distinct pairs of a block of documents. Only those
distinct pairs, with their counts, are shuffled by pair to be counted over the corpus, and
what is counted returns to the block the same way.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache, reduce
from itertools import chain, count
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chatterlake.llm.common import arrow_rows
from chatterlake.llm.tokens import WordTable, blocks, byte_alphabet, cut_each, encoder, tokenizer_path
from chatterlake.storage import fresh_path, write_table

PIECES = "piece_bpe_32k.model"
SPACE = "▁"  # how pieces write a space
RANGE_CHARS = 65_536  # longer documents are cut into ranges of about so many characters
BLOCK_LINKS = 500_000
TEXT_CHARS = 250_000  # of texts that are tokenised at a time
MAX_WORDS = 100_000  # that a worker keeps for each side
FAN_IN = 8
_LOW = (1 << 32) - 1

_BLOCK = ("block bigint, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, "
          "n_links array<bigint>, hashes array<string>, links binary, pairs array<bigint>, counts array<bigint>")
_RANGES = "row bigint, doc_id bigint, node bigint, at bigint, text string"
_FRAGMENT = ("row bigint, doc_id bigint, node bigint, sound boolean, closed boolean, before binary, groups binary, "
             "n_groups bigint, links binary, behind binary, n_a bigint, n_b bigint")
_RESULT = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, "
           "count_sum bigint, groups_sha256 string")


class Side:
    """One tokenizer: ids of texts that start with a space, and the bytes of its tokens."""

    def __init__(self, encode, token_bytes: list[bytes]):
        import pyarrow as pa

        self.encode = encode
        self._bytes = pa.array(token_bytes, pa.large_binary())
        self.lengths = np.array([len(b) for b in token_bytes], np.int64)

    def joined(self, ids: np.ndarray) -> memoryview:
        import pyarrow as pa

        taken = self._bytes.take(pa.array(ids))
        return memoryview(taken.buffers()[2] or b"").cast("B")


@cache
def byte_level_side(path: str) -> Side:
    """A byte-level BPE file of the tokenizers library; special tokens' strings are plain text."""
    from tokenizers import Tokenizer

    values = {char: value for value, char in enumerate(byte_alphabet())}
    vocabulary = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    token_bytes = [b""] * (max(vocabulary.values()) + 1)
    for token, number in vocabulary.items():
        token_bytes[number] = bytes(values[c] for c in token)
    return Side(encoder(path, True, MAX_WORDS).encode, token_bytes)


_SPACED = re.compile(" *[^ ]+| +").findall


@cache
def piece_side(path: str) -> Side:
    """A sentencepiece file that puts a space before a text.

    Texts are cut where a space follows another character, which no piece may cross.
    """
    from sentencepiece import SentencePieceProcessor

    processor = SentencePieceProcessor(model_file=path)
    pieces = [processor.id_to_piece(i) for i in range(processor.get_piece_size())]
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        raise ValueError(f"{path} has pieces that go on after a space")
    token_bytes = [bytes([int(p[3:5], 16)]) if processor.is_byte(i) else p.replace(SPACE, " ").encode()
                   for i, p in enumerate(pieces)]
    lead = len(processor.encode("a"))

    def learn(words) -> tuple[np.ndarray, np.ndarray]:
        # the processor adds the first space itself, but none to an empty text
        words = words.to_pylist()
        blank = [not w.strip(" ") for w in words]
        ids = processor.encode(["a" + w if b else w[1:] for w, b in zip(words, blank)], num_threads=1)
        ids = [x[lead:] if b else x for x, b in zip(ids, blank)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), "<u4", int(lengths.sum())), lengths

    table = WordTable(learn, MAX_WORDS)
    return Side(lambda texts: table.encode(*cut_each(_SPACED, texts)), token_bytes)


class Run(NamedTuple):
    """Tokens of both sides, with the bytes at which they end."""

    a: np.ndarray
    a_ends: np.ndarray
    b: np.ndarray
    b_ends: np.ndarray

    def join(self, other: Run) -> Run:
        return Run(*(np.concatenate(x) for x in zip(self, other)))

    def cut(self, after: int, upto: int) -> Run:
        """Tokens that end behind ``after`` and not behind ``upto``."""
        i, j = np.searchsorted(self.a_ends, [after, upto], "right")
        k, m = np.searchsorted(self.b_ends, [after, upto], "right")
        return Run(self.a[i:j], self.a_ends[i:j], self.b[k:m], self.b_ends[k:m])


NO_RUN = Run(*(np.empty(0, t) for t in ("<u4", np.int64, "<u4", np.int64)))


def _marks(run: Run) -> tuple[np.ndarray, np.ndarray]:
    """The places where tokens end, and which sides' do: 1, 2 or 3 for both."""
    least = min((int(e[0]) for e in (run.a_ends, run.b_ends) if len(e)), default=0)
    most = max((int(e[-1]) for e in (run.a_ends, run.b_ends) if len(e)), default=-1)
    mark = np.zeros(most - least + 1, np.uint8)
    mark[run.a_ends - least] = 1
    mark[run.b_ends - least] += 2
    at = np.flatnonzero(mark)
    return at + least, mark[at]


class Groups(NamedTuple):
    """Groups of a run that ends at a shared place."""

    text: np.ndarray  # bytes `a1,a2|b1;` of all groups
    text_ends: np.ndarray  # where a group's text ends
    ends: np.ndarray  # the byte of the run where a group ends
    links: np.ndarray  # pairs a << 32 | b
    link_ends: np.ndarray  # where a group's links end


@cache
def _digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 0 to ``size`` - 1, left aligned with room for one more sign, and their number."""
    width = len(str(max(size - 1, 0)))
    numbers = np.arange(size)
    count_of = np.ones(size, np.int64)
    for n in range(1, width):
        count_of += numbers >= 10 ** n
    table = np.zeros((size, width + 1), np.uint8)
    for place in range(width):
        shift = np.maximum(count_of - 1 - place, 0)
        table[:, place] = 48 + numbers // 10 ** shift % 10
    return table, count_of


def groups(run: Run) -> Groups:
    """The groups of a run; its last tokens must end at the same place."""
    at, kind = _marks(run)
    both = kind == 3
    # per end: the tokens of each side and the groups that ended before it
    of_a, of_b, group = (np.cumsum(x, dtype=np.int64) - x for x in (kind & 1, kind >> 1, both))
    links = run.a[of_a].astype(np.int64) << 32 | run.b[of_b].astype(np.int64)
    closing = np.flatnonzero(both)
    a_upto, b_upto = np.append(0, of_a[closing] + 1), np.append(0, of_b[closing] + 1)
    a_group, b_group = group[(kind & 1) > 0], group[kind > 1]
    n_a, n_b = np.arange(len(run.a)), np.arange(len(run.b))
    a_place, b_place = n_a + b_upto[a_group], n_b + a_upto[b_group + 1]
    ids = np.empty(len(n_a) + len(n_b), np.int64)
    signs = np.empty(len(ids), np.uint8)
    ids[a_place], ids[b_place] = run.a, run.b
    signs[a_place] = np.where(n_a + 1 == a_upto[a_group + 1], ord("|"), ord(","))
    signs[b_place] = np.where(n_b + 1 == b_upto[b_group + 1], ord(";"), ord(","))
    table, width = _digits(1 << 16 if not len(ids) else max(1 << 16, int(ids.max()) + 1))
    rows, widths = table[ids], width[ids]
    rows[np.arange(len(ids)), widths] = signs
    text = rows[np.arange(rows.shape[1]) <= widths[:, None]]
    upto = np.append(0, np.cumsum(widths + 1))
    return Groups(text, upto[a_upto[1:] + b_upto[1:]], at[closing], links, closing + 1)


class Fragment(NamedTuple):
    """The tokens that end in a byte range. Where no end is shared, all of them are ``before``."""

    before: Run
    closed: bool
    text: bytes
    n_groups: int
    links: np.ndarray
    behind: Run


def fragment(run: Run) -> Fragment:
    at, kind = _marks(run)
    shared = at[kind == 3]
    if not len(shared):
        return Fragment(run, False, b"", 0, np.empty(0, np.int64), NO_RUN)
    first, last = int(shared[0]), int(shared[-1])
    inner = groups(run.cut(first, last))
    return Fragment(run.cut(-1, first), True, inner.text.tobytes(), len(inner.ends), inner.links,
                    run.cut(last, np.iinfo(np.int64).max))


def compose(one: Fragment, two: Fragment) -> Fragment:
    """The fragment of two neighbouring ranges."""
    if not one.closed:
        return two._replace(before=one.before.join(two.before))
    behind = one.behind.join(two.before)
    if not two.closed:
        return one._replace(behind=behind)
    met = groups(behind)
    return Fragment(one.before, True, one.text + met.text.tobytes() + two.text, one.n_groups + 1 + two.n_groups,
                    np.concatenate([one.links, met.links, two.links]), two.behind)


def finished(whole: Fragment) -> Fragment:
    """A whole document's fragment: what is before the first shared end is a group as well."""
    start = Fragment(NO_RUN, True, b"", 0, np.empty(0, np.int64), NO_RUN)
    return compose(start, whole) if len(whole.before.a) else whole


def _run(texts: list[str], sides: tuple[Side, Side]) -> tuple[Run, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of all texts as one run, without those of texts that a side does not give back.

    Also: which texts are sound, where each text's bytes end in the run, and its tokens on each side.
    """
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    sound = sizes > 0
    tokens = []
    for side in sides:
        ids, ends = side.encode(texts)
        data = side.joined(ids)
        stops = np.append(0, np.cumsum(side.lengths[ids]))[ends].tolist()
        sound &= np.fromiter((data[a:b] == r for a, b, r in zip([0, *stops], stops, raw)), bool, len(raw))
        tokens.append((ids, np.diff(ends, prepend=0)))
    kept = []
    for side, (ids, n) in zip(sides, tokens):
        ids = ids[np.repeat(sound, n)]
        kept += [ids, np.cumsum(side.lengths[ids])]
    n_a, n_b = (np.where(sound, n, 0) for _, n in tokens)
    return Run(*kept), sound, np.cumsum(np.where(sound, sizes, 0)), n_a, n_b


def _record(schema: str, *columns):
    import pyarrow as pa

    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
             "array<bigint>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    names, types = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types)], names=names)


def _squeezed(codes: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, compressed: most are small."""
    import pyarrow as pa

    planes = np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return np.int64(len(codes)).tobytes() + pa.Codec("zstd", 1).compress(planes, asbytes=True)


def _unsqueezed(data: bytes) -> np.ndarray:
    import pyarrow as pa

    n = int(np.frombuffer(data, np.int64, 1)[0])
    planes = np.frombuffer(pa.Codec("zstd", 1).decompress(memoryview(data)[8:], 4 * n), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def _block(number: int, docs: list[tuple], links: list[np.ndarray]):
    codes, pairs = pd.factorize(np.concatenate(links) if links else np.empty(0, np.int64))
    counts = np.bincount(codes, minlength=len(pairs))
    return _record(_BLOCK, [number], *([list(c)] for c in zip(*docs)),
                   [_squeezed(codes)], [pairs], [counts])


def _text_blocks(rows: Iterator, paths: tuple[str, str], block_links: int) -> Iterator:
    from pyspark import TaskContext

    sides = byte_level_side(paths[0]), piece_side(paths[1])
    serial = count(TaskContext.get().partitionId() << 33)
    docs: list[tuple] = []
    links: list[np.ndarray] = []
    held = 0
    for batch in rows:
        doc_ids = iter(batch.column(0).to_pylist())
        given = (" " + t if (t := x.as_py()) else "" for x in batch.column(1))
        for texts in blocks(given, TEXT_CHARS):
            run, sound, ends, n_a, n_b = _run(texts, sides)
            found = groups(run)
            upto = np.searchsorted(found.ends, ends, "right")
            n_groups = np.diff(upto, prepend=0)
            text_ends = np.append(0, found.text_ends)[upto]
            link_ends = np.append(0, found.link_ends)[upto]
            n_links = np.diff(link_ends, prepend=0)
            data, start = memoryview(found.text), 0
            for i, stop in enumerate(text_ends.tolist()):
                digest = hashlib.sha256(data[start:stop - 1]).hexdigest() if sound[i] else ""
                docs.append((next(doc_ids), int(n_a[i]), int(n_b[i]), int(n_groups[i]), int(n_links[i]), digest))
                start = stop
            links.append(found.links)
            held += len(found.links)
            if held >= block_links or len(docs) >= block_links:
                yield _block(next(serial), docs, links)
                docs, links, held = [], [], 0
    if docs:
        yield _block(next(serial), docs, links)


def _ranges(rows: Iterator, chars: int) -> Iterator:
    """Byte ranges of long texts, cut before a space that follows another character."""
    for batch in rows:
        for row, doc_id, text in zip(*(batch.column(i) for i in range(3))):
            text, start, at, out = " " + text.as_py(), 0, 0, []
            while start < len(text):
                edge = start + chars
                while edge < len(text) and not (text[edge] == " " and text[edge - 1] != " "):
                    edge = text.find(" ", edge + 1)
                    edge = len(text) if edge < 0 else edge
                part = text[start:edge]
                out.append((row.as_py(), doc_id.as_py(), len(out), at, part))
                start, at = edge, at + len(part.encode())
            for piece in out:
                yield _record(_RANGES, *([x] for x in piece))


def _packed(run: Run) -> bytes:
    """Both sides of a run behind one another, with the number of tokens of the first."""
    return b"".join([np.int64(len(run.a)).tobytes(), *(np.asarray(x, "<i8").tobytes() for x in run)])


def _unpacked(data: bytes) -> Run:
    values = np.frombuffer(data, "<i8")
    n = int(values[0])
    m = (len(values) - 1 - 2 * n) // 2
    a, a_ends, b, b_ends = np.split(values[1:], [n, 2 * n, 2 * n + m])
    return Run(a.astype("<u4"), a_ends, b.astype("<u4"), b_ends)


def _row(key: tuple, sound: bool, f: Fragment, n_a: int, n_b: int) -> tuple:
    return (*key, sound, f.closed, _packed(f.before), f.text, f.n_groups, f.links.astype("<i8").tobytes(),
            _packed(f.behind), n_a, n_b)


def _read(row) -> Fragment:
    return Fragment(_unpacked(row.before), row.closed, row.groups, row.n_groups, np.frombuffer(row.links, "<i8"),
                    _unpacked(row.behind))


def _range_fragments(rows: Iterator, paths: tuple[str, str]) -> Iterator:
    sides = byte_level_side(paths[0]), piece_side(paths[1])
    for batch in rows:
        for row, doc_id, node, at, text in zip(*(batch.column(i).to_pylist() for i in range(5))):
            run, sound, _, n_a, n_b = _run([text], sides)
            run = run._replace(a_ends=run.a_ends + at, b_ends=run.b_ends + at)
            yield _record(_FRAGMENT, *([x] for x in _row(
                (row, doc_id, node), bool(sound[0]), fragment(run), int(n_a[0]), int(n_b[0]))))


_FRAGMENT_NAMES = [c.split()[0] for c in _FRAGMENT.split(", ")]


def _composed(key, part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("node")
    whole = reduce(compose, map(_read, part.itertuples()))
    doc_id = part.doc_id.iloc[0]
    row = _row((int(key[0]), None if pd.isna(doc_id) else int(doc_id), int(key[1])), bool(part.sound.all()), whole,
               int(part.n_a.sum()), int(part.n_b.sum()))
    return pd.DataFrame([row], columns=_FRAGMENT_NAMES).astype({"doc_id": "Int64"})


def compose_tree(fragments: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One fragment a document from those of its ranges (node 0, 1, ...), ``fan_in`` at a time."""
    spark = fragments.sparkSession
    current = fragments
    most = current.agg(F.max("node")).first()[0] or 0
    while most > 0:
        above = F.expr(f"node div {fan_in}")
        current = write_table(current.groupBy("row", above.alias("above")).applyInPandas(_composed, _FRAGMENT),
                              fresh_path(spark, "alignment-fragments"))
        most //= fan_in
    return current


def _long_blocks(rows: Iterator) -> Iterator:
    for batch in rows:
        for r in batch.to_pandas().itertuples():
            doc_id = None if pd.isna(r.doc_id) else int(r.doc_id)
            if not r.sound:
                yield _block(-1 - r.row, [(doc_id, 0, 0, 0, 0, "")], [])
                continue
            whole = finished(_read(r))
            digest = hashlib.sha256(memoryview(whole.text)[:-1]).hexdigest()
            yield _block(-1 - r.row, [(doc_id, r.n_a, r.n_b, whole.n_groups, len(whole.links), digest)], [whole.links])


def _counted(rows: Iterator) -> Iterator:
    for batch in rows:
        for r in range(batch.num_rows):
            doc_ids, n_a, n_b, n_groups, n_links, hashes, links, values = (
                batch.column(i)[r] for i in range(batch.num_columns))
            values = values.values.to_numpy() if values.is_valid else np.empty(0, np.int64)
            of_links = values[_unsqueezed(links.as_py())]
            n_links = n_links.values.to_numpy()
            ends = np.cumsum(n_links)
            sums = [np.append(0, np.cumsum(x)) for x in (of_links & 1, of_links >> 1)]
            best, total = (s[ends] - s[ends - n_links] for s in sums)
            yield _record(_RESULT, doc_ids.values, n_a.values, n_b.values, n_groups.values, n_links, best, total, hashes.values)


def aligned_blocks(docs: DataFrame, paths: tuple[str, str], text: str = "text", range_chars: int = RANGE_CHARS,
                   block_links: int = BLOCK_LINKS) -> DataFrame:
    """Documents in blocks with their groups and links; written and read back."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col(text).alias("text"))
    size = F.coalesce(F.char_length("text"), F.lit(0))
    short = rows.where(size <= range_chars).mapInArrow(lambda part: _text_blocks(part, paths, block_links), _BLOCK)
    ranges = write_table(
        rows.where(size > range_chars).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
        .mapInArrow(lambda part: _ranges(part, range_chars), _RANGES), fresh_path(spark, "alignment-ranges"))
    with arrow_rows(spark, 1000):
        parts = write_table(ranges.repartition("row", "node").mapInArrow(lambda part: _range_fragments(part, paths), _FRAGMENT),
                            fresh_path(spark, "alignment-fragments"))
        long = compose_tree(parts).mapInArrow(_long_blocks, _BLOCK)
        return write_table(short.unionByName(long), fresh_path(spark, "alignment-blocks"))


def pair_counts(pairs: DataFrame) -> DataFrame:
    """(pair, links, best) over the corpus; best: no other pair of the b id has more links."""
    totals = pairs.groupBy("pair").agg(F.sum("n").alias("links"))
    # an id of b meets at most as many ids of a as the vocabulary has
    most = F.max("links").over(Window.partitionBy(F.col("pair").bitwiseAND(F.lit(_LOW))))
    return totals.withColumn("best", F.col("links") == most)


def align(docs: DataFrame, text: str = "text", byte_level: str | None = None, pieces: str | None = None,
          range_chars: int = RANGE_CHARS, block_links: int = BLOCK_LINKS) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Side a is a byte-level BPE file of the tokenizers library, side b a sentencepiece model; both encode a
    space and the text. Byte offsets where tokens of both sides end cut them into groups; a link is a
    pair of tokens that overlap. ``n_best`` counts links whose pair of ids has the most links of its b id
    over the corpus, ties included; ``count_sum`` adds up the corpus counts of the links' pairs. Null and
    empty texts, and texts that the tokens of a side do not give back byte for byte, have no tokens: zeros and
    an empty string. Repeated rows are aligned and counted as often as they occur; a null doc_id
    stays null; other columns are ignored; an empty table gives no rows. Texts of more than
    ``range_chars`` characters are cut into ranges before spaces; a stretch without spaces is one range.
    """
    spark = docs.sparkSession
    paths = (byte_level or tokenizer_path(), pieces or tokenizer_path(PIECES))
    found = aligned_blocks(docs, paths, text, range_chars, block_links)
    pairs = found.select("block", F.posexplode(F.arrays_zip("pairs", "counts")).alias("at", "p")).select(
        "block", "at", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))
    totals = write_table(pair_counts(pairs), fresh_path(spark, "alignment-pairs"))
    value = F.shiftleft("links", 1) + F.col("best").cast("bigint")
    values = write_table(
        pairs.join(totals, "pair").groupBy("block").agg(
            F.sort_array(F.collect_list(F.struct("at", value.alias("value")))).getField("value").alias("counted")),
        fresh_path(spark, "alignment-counts"))
    with arrow_rows(spark, 1):  # a row is a block
        return write_table(
            found.drop("pairs", "counts").join(values, "block", "left")
            .select("doc_ids", "n_a", "n_b", "n_groups", "n_links", "hashes", "links", "counted")
            .mapInArrow(_counted, _RESULT), fresh_path(spark, "alignment"))
