"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader.

A word gives two views: the word itself in lower case, and its shape (case, symbols glued to it, and
whether it repeats the word before). Single words and pairs of either view are hashed into a fixed
number of buckets. A text is the vector of its relative frequencies, and its score the logistic of one
sparse dot product. Training visits labelled rows one by one with FTRL-proximal updates; the rows are
dealt over a fixed number of learners, whose weights are averaged. Model and training set are
bounded, so neither grows with the corpus; scoring reads every whole text where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: Bound of the training set; documented limit of this operator.
TRAINING_ROWS = 16_000
LEARNERS = 8
EPOCHS = 4
THRESHOLD = 0.3

_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _shape(word: str) -> int:
    """Case of the letters and the set of symbols, as a small number."""
    letters = [c for c in word if c.isalpha()]
    case = (0 if not letters else 1 if word.islower() else 2 if len(letters) > 1 and word.isupper()
            else 3 if letters[0].isupper() else 4)
    digits = any(c.isdigit() for c in word)
    symbols = sum(1 << (ord(c) % 7) for c in {c for c in word if not c.isalnum()})
    long = len(word) > 30
    return case | digits << 3 | (symbols & 127) << 4 | long << 11


class Features:
    """Bucket numbers of the n-grams of a text; words are hashed once and kept up to a bound."""

    def __init__(self, max_words: int = 150_000):
        self._max = max_words
        self._known: dict[str, int] = {}
        self._hash = np.zeros(1024, np.uint64)
        self._shape = np.zeros(1024, np.uint64)

    def _learn(self, new: set[str]) -> None:
        known, start = self._known, len(self._known)
        room = start + len(new)
        if room > len(self._hash):
            self._hash, self._shape = (
                np.concatenate([x, np.zeros(room, np.uint64)]) for x in (self._hash, self._shape))
        for k, w in enumerate(new, start):
            known[w] = k
            self._hash[k] = xxhash.xxh64_intdigest(w.lower().encode("utf-8", "surrogatepass"), 1)
            self._shape[k] = _shape(w)

    def buckets(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        if not words:
            return np.zeros(0, np.int64)
        if len(self._known) > self._max:
            self.__init__(self._max)
        self._learn(set(words).difference(self._known))
        codes = np.fromiter(map(self._known.__getitem__, words), np.int64, len(words))
        h, s = self._hash[codes], self._shape[codes]
        s[1:] |= (h[1:] == h[:-1]).astype(np.uint64) << np.uint64(12)
        s = (s + np.uint64(1)) * _PRIME
        with np.errstate(over="ignore"):
            pairs = [h[:-1] * np.uint64(3) + h[1:] * np.uint64(7), s[:-1] * np.uint64(5) + s[1:] * np.uint64(11)]
            every = np.concatenate([h, s, *pairs])
            every ^= every >> np.uint64(32)
            every *= _PRIME
        return (every >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


_worker = Features()


def worker_buckets(text: str | None) -> np.ndarray:
    """Buckets of a text by the words that this Python worker has seen in all of its tasks."""
    return _worker.buckets(text)


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], size: int, epochs: int = EPOCHS,
                      alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> np.ndarray:
    """FTRL-proximal weights; a row is (indices, values, label), and the last index is the bias."""
    z, n = np.zeros(size), np.zeros(size)
    for _ in range(epochs):
        for index, value, label in rows:
            zi, ni = z[index], n[index]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (sigmoid(w @ value) - label) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[index] = ni + g * g
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))


#: Relative frequencies are far below 1; the factor lets single rows move the weights.
_SCALE = 20.0


def _vector(buckets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, count = np.unique(buckets, return_counts=True)
    value = _SCALE * count / max(1, len(buckets))
    return np.append(index, BUCKETS), np.append(value, 1.0)


def train(docs: DataFrame, labels: DataFrame, text: str = "text", max_rows: int = TRAINING_ROWS,
          learners: int = LEARNERS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights of ``BUCKETS`` buckets and the bias.

    ``labels`` has doc_id and label (0 or 1). At most ``max_rows`` of its documents are used: those
    whose hashed ids are the smallest, so the choice does not depend on order or partitioning.
    Null labels and labels of absent documents are ignored; of several labels of a document the
    largest counts. Without rows all weights are 0 and every score is 0.5.
    """
    chosen = (
        labels.where(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("label").cast("int").alias("label_"))
        .withColumn("order_", F.xxhash64("doc_id")).orderBy("order_", "doc_id").limit(max_rows)
    )

    def learn(shard):
        shard = shard.sort_values(["order_", "text_"], kind="stable")
        rows = [(*_vector(worker_buckets(t)), int(y)) for t, y in zip(shard["text_"], shard["label_"])]
        w = follow_the_leader(rows, BUCKETS + 1, epochs)
        kept = np.flatnonzero(w)
        return pd.DataFrame({"bucket": np.append(kept, -1), "w": np.append(w[kept], 1.0) * len(rows)})

    rows = docs.select("doc_id", F.col(text).alias("text_")).join(
        F.broadcast(chosen), "doc_id").withColumn("learner", F.pmod("order_", F.lit(learners)))
    learnt = rows.drop("doc_id").groupBy("learner").applyInPandas(learn, "bucket bigint, w double")
    total = dict(learnt.groupBy("bucket").agg(F.sum("w")).collect())  # at most BUCKETS + 2 numbers
    weights = np.zeros(BUCKETS + 1)
    rows_seen = total.pop(-1, 1.0)
    for bucket, w in total.items():
        weights[bucket] = w / rows_seen
    return weights


def score(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1 for every row; null counts as empty.

    A text without words has the score of the bias alone. An existing column of the score's name
    is replaced.
    """
    compact = weights.astype(np.float32)
    bias = float(weights[BUCKETS])

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.empty(len(texts))
            for i, t in enumerate(texts):
                b = worker_buckets(t)
                out[i] = bias + (_SCALE * float(compact[b].sum(dtype=np.float64)) / len(b) if len(b) else 0.0)
            yield pd.Series(sigmoid(out))

    return docs.withColumn(name, scored(F.col(text)))
