"""Repeated passages by FM-indexes over shards.

A window is ``window`` consecutive words. Every window has an anchor, the least hash among its word
``gram``-grams, so equal windows have equal anchors and a document has few. Documents with the same
words are reduced to one first. An anchor that stands in one document only settles all its windows.
The stretch of text around each other anchor, a segment, goes to the shard of the anchor; equal segments
are reduced to the one of the smallest doc_id. A shard builds a compressed FM-index (the Burrows-Wheeler
transform of its segments in a wavelet matrix) and streams the segments through it: backward search
finds, from an end, how far back the words also stand in a smaller document. Those matching
statistics are taken at few ends, since a match settles all windows within it and a failure all
windows around it.

An anchor of more than ``HOT_DOCUMENTS`` documents would fill a shard with the many contexts of one
passage. Of its segments, too, equal ones are reduced to one; what is left is told apart window by
window, each going where its own hash sends it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.llm.wavelet import WaveletMatrix
from chatterlake.storage import fresh_path, write_table

WINDOW = 50
GRAM = 16
HOT_DOCUMENTS = 256
SHARD_WORDS = 1 << 19
BATCH_ROWS = 512

_BASE = 0x9E3779B97F4A7C15 | 1
_BASES = (_BASE, 0xC2B2AE3D27D4EB4F)
_INVERSES = tuple(pow(b, -1, 1 << 64) for b in _BASES)
_powers: list[list[np.ndarray]] = [[np.ones(1, np.uint64)] * 2 for _ in _BASES]


def split_words(text: str | None) -> list[bytes]:
    """Words between ASCII white space, unchanged, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BLOCK = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, each from the bytes of its word alone.

    Long texts are taken in blocks that end at white space.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out, start = [], 0
    while start < len(data):
        end = min(start + _BLOCK, len(data))
        if end < len(data):
            gap = _SPACE[data[end:]]
            end += int(gap.argmax()) if gap.any() else len(gap)
        out.append(_block_hashes(data[start:end]))
        start = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _block_hashes(data: np.ndarray) -> np.ndarray:
    inside = np.concatenate([[False], ~_SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1]).reshape(-1, 2)
    up, down = _powers_to(len(data) + 1, 0)
    total = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1])])
    return _mixed((total[edge[:, 1]] - total[edge[:, 0]]) * down[edge[:, 0]])


def _powers_to(n: int, which: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers[which]
    if len(up) < n:
        size = 1 << (n - 1).bit_length()
        up, down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, b, np.uint64))])
                    for b in (_BASES[which], _INVERSES[which]))
        _powers[which] = [up, down]
    return up[:n], down[:n]


def rolling(h: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of ``width`` values, mixed; equal runs have equal hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers_to(len(h), which)
    total = np.concatenate([[np.uint64(0)], np.cumsum(h * up)])
    return _mixed((total[width:] - total[:-width]) * down[:n])


def anchors(h: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window, the least hash among its grams.

    Least values of whole blocks from either side give those of every stretch in linear time.
    """
    grams, span = rolling(h, gram), window - gram + 1
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    blocks = np.full(-(-len(grams) // span) * span, ~np.uint64(0))
    blocks[:len(grams)] = grams
    blocks = blocks.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[span - 1:span - 1 + n])


def stretches(of_window: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last windows of runs with one anchor, cut after ``most`` windows."""
    first = np.flatnonzero(np.append(True, of_window[1:] != of_window[:-1])[:len(of_window)])
    length = np.diff(np.append(first, len(of_window)))
    parts = -(-length // most)
    first = np.repeat(first, parts)
    step = np.arange(len(first)) - np.repeat(np.cumsum(parts) - parts, parts)
    first = first + step * most
    return first, np.append(first[1:], len(of_window)) - 1


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _pieces(rows: Iterator) -> Iterator:
    """Batches of at most ``BATCH_ROWS`` texts: Python's lists of words and numbers take many times their bytes."""
    for batch in rows:
        for a in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(a, BATCH_ROWS)


def _profile(rows: Iterator, window: int, gram: int) -> Iterator:
    """doc_id, text_hash, n_words, words_hash (two hashes of all words), anchors of each document."""
    import pyarrow as pa

    for batch in _pieces(rows):
        n_words, first, second, found = [], [], [], []
        for t in batch.column(2):
            h = word_hashes(t.as_py())
            n_words.append(len(h))
            first.append(rolling(h, len(h))[0] if len(h) else np.uint64(0))
            second.append(rolling(h, len(h), 1)[0] if len(h) else np.uint64(0))
            found.append(_signed(np.unique(anchors(h, window, gram))))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
            pa.array(_signed(np.array(first, np.uint64))), pa.array(_signed(np.array(second, np.uint64))),
            pa.array(found, pa.list_(pa.int64())),
        ], names=["doc_id", "text_hash", "n_words", "words_a", "words_b", "anchors"])


_PROFILE = "doc_id bigint, text_hash bigint, n_words bigint, words_a bigint, words_b bigint, anchors array<bigint>"
_SEGMENT = ("doc_id bigint, text_hash bigint, anchor bigint, segment bigint, first bigint, last bigint, "
            "words binary, whole array<bigint>, other array<bigint>")


def _segments(rows: Iterator, window: int, gram: int) -> Iterator:
    """The segments of repeated anchors: windows ``first`` to ``last`` and their words, or, where the
    anchor is hot, two hashes of each window."""
    import pyarrow as pa

    names = [c.split()[0] for c in _SEGMENT.split(", ")]
    for batch in _pieces(rows):
        out: list[list] = [[] for _ in names]
        for doc_id, text_hash, text, repeated, hot in zip(*(batch.column(i).to_pylist() for i in range(5))):
            words = split_words(text)
            h = word_hashes(text)
            of_window = _signed(anchors(h, window, gram))
            edge, last = stretches(of_window, window - gram + 1)
            wanted = np.isin(of_window[edge], np.array(repeated, np.int64))
            is_hot = np.isin(of_window[edge], np.array(hot, np.int64))
            hashes = [_signed(rolling(h, window, k)) for k in (0, 1)] if is_hot.any() else None
            for a, b, apart in zip(*(x[wanted].tolist() for x in (edge, last, is_hot))):
                part = b" ".join(words[a:b + window])
                each = [x[a:b + 1].tolist() for x in hashes] if apart else (None, None)
                for column, value in zip(out, (
                        doc_id, text_hash, int(of_window[a]), xxhash.xxh64_intdigest(part, 5) - (1 << 63), a, b,
                        None if apart else part, *each)):
                    column.append(value)
        kinds = {"words": pa.binary(), "whole": pa.list_(pa.int64()), "other": pa.list_(pa.int64())}
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(out, names)], names=names)


class FMIndex:
    """Backward search over sequences of small integers (from 1), each of which has an owner.

    Suffixes are sorted to a depth beyond any pattern, which is all that backward search needs.
    """

    def __init__(self, sequences: list[np.ndarray], owners: np.ndarray, deepest: int):
        text = np.concatenate([np.append(s, 0) for s in sequences]).astype(np.int64)
        rank, depth, n = text, 1, len(text)
        while depth <= deepest:
            key = rank * np.int64(rank.max() + 1) + np.concatenate([rank[depth:], np.zeros(min(depth, n), np.int64)])[:n]
            order = np.argsort(key, kind="stable")
            step = np.append(False, key[order][1:] != key[order][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(step)
            depth *= 2
            if rank[order[-1]] == n - 1:
                break
        order = np.argsort(rank, kind="stable")
        self.bwt = WaveletMatrix.build(text[order - 1])
        used = np.bincount(text)
        self.before = np.concatenate([[0], np.cumsum(used)])
        self.least = [np.repeat(owners, [len(s) + 1 for s in sequences])[order].astype(np.int32)]
        width = 1
        while 2 * width <= n:
            low = self.least[-1]
            self.least.append(np.minimum(low[:-width], low[width:]))
            width *= 2

    def extend(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns with one symbol more in front."""
        edge = self.bwt.rank_many(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]))
        base = self.before[symbol]
        return base + edge[:len(lo)], base + edge[len(lo):]

    def least_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Smallest owner in non-empty suffix ranges."""
        level = np.frexp((hi - lo).astype(np.float64))[1] - 1
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][lo[at]], self.least[k][hi[at] - (1 << int(k))])
        return out

    def match_starts(self, text: np.ndarray, end: np.ndarray, floor: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """For patterns of ``text`` that end at ``end``: how far back, at least to ``floor``, they
        stand in a sequence of a smaller owner; end + 1 if not at all."""
        lo, hi = np.zeros(len(end), np.int64), np.full(len(end), self.bwt.n, np.int64)
        start, live = end + 1, np.arange(len(end))
        while len(live):
            live = live[start[live] > floor[live]]
            a, b = self.extend(text[start[live] - 1], lo[live], hi[live])
            held = np.flatnonzero(b > a)
            live, a, b = live[held], a[held], b[held]
            smaller = self.least_owner(a, b) < owner[live] if len(live) else np.zeros(0, bool)
            live, a, b = live[smaller], a[smaller], b[smaller]
            lo[live], hi[live] = a, b
            start[live] -= 1
        return start


def repeated_windows(sequences: list[np.ndarray], owners: np.ndarray, window: int) -> list[np.ndarray]:
    """Per sequence, for each of its windows whether it also stands in a sequence of a smaller owner.

    Ranges of open window ends are probed from the right; a failed probe splits its range at the
    word that broke the match, and the right part is then probed from the left.
    """
    index = FMIndex(sequences, owners, max(map(len, sequences)) + 1)
    text = np.concatenate(sequences)
    lengths = np.array([len(s) for s in sequences])
    base = np.cumsum(lengths) - lengths
    found = np.zeros(len(text) + 1, np.int64)  # +1 where a run of matched ends begins, -1 after it
    which = np.arange(len(sequences))
    left, right = base + window - 1, base + lengths - 1
    from_left = np.zeros(len(which), bool)
    while len(which):
        open_ = left <= right
        which, left, right, from_left = which[open_], left[open_], right[open_], from_left[open_]
        if not len(which):
            break
        end = np.where(from_left, left, right)
        floor = np.where(from_left, end - window + 1, base[which])
        start = index.match_starts(text, end, floor, owners[which])
        hit = end - start + 1 >= window
        # matched: all ends whose windows lie within [start, end]
        first = np.maximum(left, start + window - 1)
        np.add.at(found, np.where(from_left, end, first)[hit], 1)
        np.add.at(found, end[hit] + 1, -1)
        broke = start - 1
        l1 = np.where(from_left, np.where(hit, left + 1, broke + window), left)
        r1 = np.where(from_left, right, np.where(hit, first - 1, np.minimum(broke, right) - 1))
        split = ~from_left & ~hit
        l2, r2 = np.maximum(broke, left)[split], right[split] - 1
        which = np.concatenate([which, which[split]])
        left, right = np.concatenate([l1, l2]), np.concatenate([r1, r2])
        from_left = np.concatenate([np.zeros(len(l1), bool), np.ones(len(l2), bool)])
    matched = np.cumsum(found[:-1]) > 0
    return [matched[b + window - 1:b + n] for b, n in zip(base, lengths)]


def _search(shard: pd.DataFrame, window: int) -> pd.DataFrame:
    """Windows of the segments of a shard that also stand in a segment of a smaller document."""
    words = [bytes(w).split() for w in shard["words"]]
    codes: dict[bytes, int] = {}
    sequences = [np.array([codes.setdefault(w, len(codes) + 1) for w in ws], np.int64) for ws in words]
    owners = np.unique(shard["owner"].to_numpy(), return_inverse=True)[1]
    out: dict[str, list] = {"anchor": [], "segment": [], "from_": [], "to_": []}
    for anchor, segment, hit in zip(shard["anchor"], shard["segment"], repeated_windows(sequences, owners, window)):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
        for a, b in edge.reshape(-1, 2):
            for column, value in zip(out.values(), (anchor, segment, a, b - 1)):
                column.append(value)
    return pd.DataFrame(out).astype("int64")


def _hot_matches(segments: DataFrame) -> DataFrame:
    """Windows of hot segments that also stand in a segment of a smaller document, by their hashes."""
    spark = segments.sparkSession
    hashes = ["whole", "other"]
    # not stored: there are many times more of them than segments, and the second reading costs no shuffle
    windows = (segments.select("anchor", "segment", "owner", F.posexplode(F.arrays_zip(*hashes)).alias("from_", "h"))
               .select("anchor", "segment", "owner", "from_", "h.*"))
    least = write_table(
        windows.groupBy(*hashes).agg(F.min("owner").alias("least"), F.count(F.lit(1)).alias("n"))
        .where("n > 1").drop("n"), fresh_path(spark, "hot-repeats"), narrow=True)
    return windows.join(least, hashes).where("owner > least").select(
        "anchor", "segment", F.col("from_").cast("bigint"), F.col("from_").cast("bigint").alias("to_"))


#: A null doc_id counts as larger than all others.
def _id(doc_id: Column) -> Column:
    return F.coalesce(doc_id.cast("bigint"), F.lit((1 << 63) - 1))


def repeated_ranges(docs: DataFrame, text: str = "text", window: int = WINDOW, gram: int = GRAM,
                    hot: int = HOT_DOCUMENTS, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, text_hash, n_words, copied, ranges): a row per document and text.

    ``ranges`` holds first and last of runs of windows that also start in a document with a smaller
    doc_id; ``copied`` is set where the whole word sequence does, and ranges are then left out.
    A null doc_id is given as the largest number.
    """
    spark = docs.sparkSession
    keyed = docs.select(_id(F.col("doc_id")).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    profile = write_table(
        keyed.mapInArrow(lambda rows: _profile(rows, window, gram), _PROFILE), fresh_path(spark, "profiles"))
    same = ["words_a", "words_b", "n_words"]
    # stored first, so that the join can be split where a third of all rows are copies of one text
    least = write_table(
        profile.groupBy(*same).agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .where((F.col("n") > 1) & (F.col("n_words") >= window)).drop("n"),
        fresh_path(spark, "copied-texts"), narrow=True)
    marked = write_table(
        profile.drop("anchors").join(least, same, "left").select(
            "doc_id", "text_hash", "n_words",
            F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copied")).distinct(),
        fresh_path(spark, "marked"), narrow=True)
    places = profile.where(F.col("n_words") >= window).join(
        marked.where(~F.col("copied")).select("doc_id", "text_hash"), ["doc_id", "text_hash"]
    ).select("doc_id", "text_hash", F.explode("anchors").alias("anchor")).distinct()
    shared = (
        places.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n"))
        .where("a < b").select("anchor", (F.col("n") > hot).alias("hot"))
    )
    wanted = places.join(shared, "anchor").groupBy("doc_id", "text_hash").agg(
        F.collect_list("anchor").alias("repeated"),
        F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))
    segments = write_table(
        keyed.join(wanted, ["doc_id", "text_hash"]).select("doc_id", "text_hash", "text", "repeated", "hot")
        .mapInArrow(lambda rows: _segments(rows, window, gram), _SEGMENT), fresh_path(spark, "segments"))
    groups = ["anchor", "segment"]
    # distinct segments with their smallest document; of these, anchors with one segment are settled
    distinct = segments.groupBy(*groups).agg(F.min("doc_id").alias("owner"),
                                            *[F.first(c).alias(c) for c in ("words", "whole", "other")],
                                            F.first(F.col("last") - F.col("first") + window).alias("size"))
    distinct = write_table(distinct, fresh_path(spark, "distinct-segments"))
    several = write_table(
        distinct.groupBy("anchor").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("words").isNotNull(), F.col("size"))).alias("size"))
        .where("n > 1").select("anchor", "size"), fresh_path(spark, "open-anchors"), narrow=True)
    size = several.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_words))
    named = [*groups, "owner"]
    open_ = several.select("anchor")
    hits = (
        distinct.where("words IS NOT NULL").select(*named, "words").join(open_, "anchor", "left_semi")
        .withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)))
        .groupBy("shard").applyInPandas(lambda s: _search(s, window), "anchor bigint, segment bigint, from_ bigint, to_ bigint")
    )
    found = hits.unionByName(_hot_matches(
        distinct.where("whole IS NOT NULL").select(*named, "whole", "other").join(open_, "anchor", "left_semi")))
    narrow = segments.select("doc_id", "text_hash", *groups, "first", "last")
    owned = narrow.join(distinct.select(*groups, "owner"), groups)
    ranges = (
        owned.where("doc_id > owner").select("doc_id", "text_hash", "first", "last")
        .unionByName(
            owned.where("doc_id = owner").join(found, groups).select(
                "doc_id", "text_hash", (F.col("first") + F.col("from_")).alias("first"),
                (F.col("first") + F.col("to_")).alias("last")))
        .groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set(F.struct("first", "last"))).alias("ranges"))
    )
    return marked.join(ranges, ["doc_id", "text_hash"], "left")


def _cut(rows: Iterator, window: int) -> Iterator:
    import pyarrow as pa

    for batch in _pieces(rows):
        n_words, n_removed, kept = [], [], []
        for text, copied, ranges in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
            words = split_words(text)
            cover = np.zeros(len(words) + 1, np.int64)
            for r in [{"first": 0, "last": len(words) - window}] if copied else ranges or ():
                cover[r["first"]] += 1
                cover[r["last"] + window] -= 1
            keep = np.cumsum(cover[:-1]) == 0
            n_words.append(len(words))
            n_removed.append(len(words) - int(keep.sum()))
            kept.append(b" ".join([words[i] for i in np.flatnonzero(keep)]))
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
            pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            pa.array([k.decode("utf-8", "surrogatepass") for k in kept], pa.string())],
            names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, **options) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept_text.

    A word goes if a window covers it that also starts in a document with a smaller doc_id; of equal
    windows within one document, or in rows that share a doc_id, none is the smaller. Null and empty texts
    have no words and keep the empty text; texts of fewer than ``window`` words keep all. A null
    doc_id counts as larger than any other. Other columns are ignored; an empty table gives no rows.
    """
    ranges = repeated_ranges(docs, text, window, **options)
    keyed = docs.select("doc_id", _id(F.col("doc_id")).alias("id_"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return (
        keyed.join(ranges.select(F.col("doc_id").alias("id_"), "text_hash", "copied", "ranges"), ["id_", "text_hash"], "left")
        .select(F.col("doc_id").cast("bigint"), "text", "copied", "ranges")
        .mapInArrow(lambda rows: _cut(rows, window),
                    "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string")
    )


ORACLE = """
    WITH d AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    win AS (
        SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS words FROM (
            SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
    gone AS (
        SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS pos FROM (
            SELECT *, min(doc_id) OVER (PARTITION BY words) AS least FROM win) WHERE least < doc_id),
    kept AS (
        SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS words FROM (
            SELECT doc_id, unnest(range(1, len(w) + 1)) AS pos, unnest(w) AS word FROM d)
        ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed,
        sha256(coalesce(words, '')) AS kept_sha256
    FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""
