"""Admission, model contracts, validation and topics against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta
from math import floor, log

import pandas as pd
import pytest
from pyspark.sql import functions as F

from chatterlake.functions import models as M
from chatterlake.operators import budget as B
from chatterlake.operators import enrich as K
from chatterlake.operators import quality as Q


@pytest.mark.parametrize("limit, window", [(1, 300), (3, 60), (5, 600)])
def test_admission_matches_a_sequential_limiter(spark, limit, window):
    rng = random.Random(limit)
    calls, start = [], datetime(2024, 1, 1)
    for client in ("hot", "warm", "cold"):
        moment = start
        for _ in range({"hot": 400, "warm": 150, "cold": 20}[client]):
            moment += timedelta(seconds=rng.choice([0, 1, 7, 30, window, 2 * window, 900]))
            calls.append((len(calls), client, moment))
    expected, kept = {}, {}
    for i, client, moment in sorted(calls, key=lambda c: (c[2], c[0])):
        recent = [t for t in kept.get(client, []) if t > moment - timedelta(seconds=window)]
        expected[i] = len(recent) < limit
        kept[client] = recent + [moment] if expected[i] else recent
    df = spark.createDataFrame(calls, "id bigint, client string, ts timestamp_ntz")
    got = B.admit_sliding(df, "client", "ts", "id", limit, window).collect()
    assert {r.id: r.admitted for r in got} == expected


def test_running_total_of_one_hot_group(spark):
    rows = [(i, "hot", datetime(2024, 1, 1), i % 7) for i in range(500)]
    df = spark.createDataFrame(rows, "id bigint, g string, ts timestamp_ntz, v bigint")
    got = {r.id: r.s for r in B.running_total(df, "g", ["ts", "id"], "v", "s").collect()}
    total, expected = 0, {}
    for i, _, _, v in rows:
        total += v
        expected[i] = total
    assert got == expected


def test_topic_matches_brute_force(spark):
    rng = random.Random(7)
    words = ["spark", "data", "lake", "the", "of", "join", "stream", "table", "x", "Plan"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 12, 60]))) for _ in range(120)]
    counts = []
    for t in texts:
        kept = [w for w in t.lower().split() if len(w) >= 2 and w not in M.STOP_WORDS]
        counts.append(Counter(kept + [f"{a} {b}" for a, b in zip(kept, kept[1:])]))
    df = Counter(term for c in counts for term in c)
    n = float(len(texts))
    expected = {}
    for i, c in enumerate(counts):
        best = min(((-floor(tf * (log((n + 1) / df[t]) / log(n + 1)) * 1e6 + 0.5), t)
                    for t, tf in c.items()), default=(0, "unknown"))
        expected[i] = best[1]
    posts = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    assert {r.id: r.topic_label for r in K.extract_topic(posts, "id").collect()} == expected


def test_model_labels_and_blank_texts(spark):
    df = spark.createDataFrame([(" Label_0 ",), ("NEGATIVE",), ("label_1",), ("?",)], "t string")
    got = [r.l for r in df.select(M.map_sentiment_label(F.col("t")).alias("l")).collect()]
    assert got == ["positive", "negative", "neutral", "neutral"]
    blank = spark.createDataFrame([("  ",), (None,)], "text string")
    rows = K.detect_language(K.score_sentiment(blank)).collect()
    assert {(r.sentiment, r.sentiment_confidence, r.language) for r in rows} == {
        ("neutral", 0.0, "unknown")}


@pytest.mark.parametrize("answer, label, confidence", [
    ('{"label": " Positive ", "confidence": 0.8}', "positive", 0.8),
    ('{"label": "great", "confidence": 1.7}', "neutral", 1.0),
    ('{"label": "negative", "confidence": -0.2}', "negative", 0.0),
    ('{"label": "negative", "confidence": "high"}', "negative", 0.0),
    ('{"confidence": 1}', "neutral", 1.0),
    ("{}", "neutral", 0.0), ("nope", "neutral", 0.0), (None, "neutral", 0.0),
])
def test_model_answers(spark, answer, label, confidence):
    df = spark.createDataFrame([(answer,)], "a string")
    r = df.select(M.parse_model_json(F.col("a"), F.lit("m/v1"), "label").alias("r")).first().r
    assert (r.label, r.confidence) == (label, confidence)
    empty = answer in ("{}", "nope", None)
    assert r.model_version == ("unknown" if empty else "v1")


def test_external_model_gets_cut_input_and_keeps_rows(spark):
    def load():
        return lambda texts: pd.DataFrame({"size": texts.str.len()})

    posts = spark.createDataFrame([(i, "y" * i) for i in range(30)], "id bigint, text string")
    rows = K.apply_model(posts, load, "text", "size bigint", max_chars=12).collect()
    assert {r.id: r.size for r in rows} == {i: min(i, 12) for i in range(30)}
    assert {len(r.text) for r in rows} == set(range(30))


def test_request_rules(spark):
    rows = [("ok", "reddit", "2024-01-01", "2024-12-31"), (" ", "reddit", "2024-01-01",
            "2024-01-02"), ("k" * 201, "fax", "2024-1-1", "2024-01-02"),
            ("k", "reddit", "2024-02-02", "2024-02-01"), ("k", "reddit", "2023-01-01",
                                                       "2024-01-02")]
    df = spark.createDataFrame(rows, "keyword string, platform string, start_date string, "
                                     "end_date string")
    errors = [r.errors for r in Q.validate_requests(df).collect()]
    assert errors[0] is None
    assert errors[1] == "keyword must not be empty"
    assert errors[2].count(";") == 2
    assert errors[3] == "end_date must be on or after start_date"
    assert errors[4] == "date range must be 365 days or less"


def test_unknown_prompt_stops(spark):
    prompts = spark.createDataFrame([("a", "v1", "p")], "key string, version string, prompt string")
    calls = spark.createDataFrame([("b",)], "key string")
    with pytest.raises(Exception, match="no prompt registered"):
        K.attach_prompt(calls, prompts).collect()
