"""Language identification as multilingual mixture inference.

Training counts hashed byte trigrams of letters per language, over all training documents; the
counts form one table of ``BUCKETS`` likelihoods per language. A document is a mixture: expectation-
maximisation estimates each language's share from the likelihoods of its trigrams. The languages are
then ranked by share, the mixture is fitted anew to the best one, two, three and so on up to all, and the
set with the highest likelihood, less a penalty for each further language, is the answer. Sizes that
cannot win, as even the best mixture of all languages would not outweigh their penalty, are not fitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 16
SMOOTHING = 0.05
STEPS = 20
UNDETERMINED = "und"

_PLAIN = bytes(b if b >= 0x80 or 97 <= b <= 122 else 32 for b in range(256))


def trigrams(text: str | None) -> np.ndarray:
    """Buckets of the byte trigrams of a text's lower-cased letters; runs of others are one space."""
    if not any(map(str.isalpha, text or "")):
        return np.zeros(0, np.int64)
    raw = b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" "
    b = np.frombuffer(raw, np.uint8)
    b = b[np.append(True, (b[1:] != 32) | (b[:-1] != 32))].astype(np.uint32)
    grams = b[:-2] | b[1:-1] << np.uint32(8) | b[2:] << np.uint32(16)
    return (grams * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.int64)


@dataclass
class Model:
    """Languages and, by bucket, the likelihood of a trigram in each."""

    languages: list[str]
    likelihood: np.ndarray


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Trigram likelihoods from all rows with a text and a language.

    Counts are summed per task before they are shuffled. The driver receives at most ``BUCKETS``
    numbers a language. Without rows the model knows no language.
    """

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, code in zip(batch.column(0), batch.column(1).to_pylist()):
                if code not in totals:
                    totals[code] = np.zeros(BUCKETS, np.int64)
                grams = trigrams(t.as_py())
                if len(grams) > BUCKETS // 4:
                    totals[code] += np.bincount(grams, minlength=BUCKETS)
                else:
                    np.add.at(totals[code], grams, 1)
        for code, n in totals.items():
            used = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([code] * len(used), pa.string()), pa.array(used), pa.array(n[used])],
                names=["lang", "bucket", "n"])

    counted = (
        docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
        .select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
        .mapInArrow(count, "lang string, bucket bigint, n bigint")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    )
    codes = np.array(counted.column("lang").to_pylist(), object)
    bucket, n = counted.column("bucket").to_numpy(), counted.column("n").to_numpy()
    languages = sorted(set(codes))
    likelihood = np.full((BUCKETS, len(languages)), SMOOTHING)
    for k, code in enumerate(languages):
        rows = codes == code
        likelihood[bucket[rows], k] += n[rows]
    likelihood /= likelihood.sum(0)
    return Model(languages, likelihood.astype(np.float32))


def mixture(likelihood: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Shares of the columns of ``likelihood`` that fit the counted rows, and their log-likelihood."""
    k, total = likelihood.shape[1], counts.sum()
    share = np.full(k, 1.0 / k, np.float32)
    for _ in range(steps if k > 1 else 0):
        joint = likelihood @ share
        new = share * ((counts / joint) @ likelihood) / total
        moved = np.abs(new - share).max()
        share = new
        if moved < 1e-3:
            break
    return share, float(counts @ np.log(likelihood @ share))


def identify(text: str | None, model: Model) -> list[tuple[str, float]]:
    """The language set of a text with shares, largest first; empty if it has no letter."""
    grams = trigrams(text)
    if not len(grams) or not model.languages:
        return []
    gram, counts = np.unique(grams, return_counts=True)
    counts = counts.astype(np.float32)
    rows = model.likelihood[gram]
    share, fit = mixture(rows, counts)
    ranked = np.argsort(-share, kind="stable")
    # a further language costs two free numbers: that it is there, and its share
    penalty = np.log(len(grams) + 1)
    # no shares fit better than this: the log-likelihood is concave, and its slopes bound what is left
    slopes = (counts / (rows @ share)).astype(np.float64) @ rows / len(grams)
    most = fit + len(grams) * max(0.0, float(np.log(slopes.max())))
    best, answer = -np.inf, None
    for size in range(1, len(ranked) + 1):
        if most - penalty * size <= best:
            break
        chosen = ranked[:size]
        part, fit = mixture(rows[:, chosen], counts)
        if fit - penalty * size > best:
            best, answer = fit - penalty * size, (chosen, part)
    chosen, part = answer
    order = np.argsort(-part, kind="stable")
    return [(model.languages[chosen[i]], float(part[i])) for i in order]


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """One row per input row: doc_id, lang_pred, score, languages, shares.

    ``lang_pred`` is the language with the largest share of the chosen set, ``score`` that share. A text
    that is null, empty or without a letter is ``und`` with score 0, and so is every text if the
    model knows no language. Repeated rows are judged alike; other columns are ignored.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [identify(t.as_py(), model) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([
                batch.column(0),
                pa.array([f[0][0] if f else UNDETERMINED for f in found], pa.string()),
                pa.array([min(1.0, f[0][1]) if f else 0.0 for f in found], pa.float64()),
                pa.array([[x[0] for x in f] for f in found], pa.list_(pa.string())),
                pa.array([[x[1] for x in f] for f in found], pa.list_(pa.float64())),
            ], names=["doc_id", "lang_pred", "score", "languages", "shares"])

    return docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(
        run, "doc_id bigint, lang_pred string, score double, languages array<string>, shares array<double>")
