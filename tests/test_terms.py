"""The Arrow term kernel against plain Python, and topic queries that run side by side."""

import math
import re
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from chatterlake import catalog
from chatterlake.functions import models as M
from chatterlake.functions import terms
from chatterlake.operators import enrich

LISTS = M.word_lists()
texts = st.lists(st.one_of(st.none(), st.lists(
    st.sampled_from(["good", "bad", "the", "tea", "cup", "é_1", "a", "42", "!", "und", "日本"]), max_size=12).map(" ".join)),
    min_size=1, max_size=8)


def usable(text):
    return [w for w in re.findall(r"\w+", text or "") if len(w) >= 2 and w not in M.STOP_WORDS]


def plain_terms(words):
    return Counter([*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))])


def frequencies(lists):
    out = {}
    for batch in terms.frequency_batches(iter([pa.record_batch([pa.array(lists, pa.list_(pa.string()))], ["w"])])):
        for h1, h2, df in zip(*(c.to_pylist() for c in batch.columns)):
            out[h1, h2] = out.get((h1, h2), 0) + df
    return out


@settings(max_examples=150, deadline=None)
@given(texts)
def test_analysis_counts_hits_and_keeps_topic_words(values):
    got = terms.analysis(LISTS, M.STOP_WORDS)(pa.array(values, pa.string())).to_pylist()
    for text, row in zip(values, got, strict=True):
        words = re.findall(r"\w+", text or "")
        assert row.pop("w") == usable(text)
        assert row == {n: sum(w in listed for w in words) for n, listed in LISTS.items()}


@settings(max_examples=150, deadline=None)
@given(texts)
def test_terms_and_frequencies(values):
    lists = [usable(t) for t in values]
    found = terms.terms_of(terms.from_lists(pa.array(lists, pa.list_(pa.string()))))
    spelled = found.spelled(list(range(len(found.text))))
    assert {(t, s): n for t, s, n in zip(found.text.tolist(), spelled, found.tf.tolist())} == {
        (i, s): n for i, words in enumerate(lists) for s, n in plain_terms(words).items()}
    df = Counter(s for words in lists for s in plain_terms(words))
    assert sorted(frequencies(lists).values()) == sorted(df.values())


def test_hashes_do_not_depend_on_the_block():
    one = frequencies([["green", "tea"], ["tea", "green"]])
    two = Counter(frequencies([["green", "tea"]])) + Counter(frequencies([["tea", "green"]]))
    assert one == two and len(one) == 4  # green, tea, green tea, tea green


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab bc cd de ef fg".split()), max_size=10), min_size=1, max_size=12), st.integers(0, 5))
def test_candidates_hold_the_best_term(lists, known):
    """Whatever share of the frequencies the tasks know, the winner and its ties are kept."""
    df = Counter(s for words in lists for s in plain_terms(words))
    total = len(lists)
    idf = {s: math.log((total + 1) / n) / math.log(total + 1) for s, n in df.items()}
    column = pa.array(lists, pa.list_(pa.string()))
    found = terms.terms_of(terms.from_lists(column))
    h1, h2 = found.hashes()
    named = {s: (a, b) for s, a, b in zip(found.spelled(list(range(len(h1)))), h1.tolist(), h2.tolist())}
    top = sorted(df, key=lambda s: (-df[s], s))[:known]
    rows = sorted((*named[s], idf[s]) for s in top)
    import numpy as np

    frequent = terms.Frequent(*(np.array([r[i] for r in rows], t) for i, t in enumerate((np.int64, np.int64, float))),
                              min((idf[s] for s in top), default=0.0))
    batch = pa.record_batch([pa.array(range(total)), column], ["key", "w"])
    kept = {}
    for out in terms.candidate_batches(iter([batch]), frequent):
        for key, term in zip(out.column("key").to_pylist(), out.column("term").to_pylist()):
            kept.setdefault(key, set()).add(term)
    for key, words in enumerate(lists):
        scores = {s: math.floor(n * idf[s] * 1e6 + 0.5) for s, n in plain_terms(words).items()}
        best = {s for s, v in scores.items() if v == max(scores.values())}
        assert best <= kept.get(key, set())


def test_topics_of_odd_posts(spark):
    rows = [(1, None), (2, ""), (3, "the a I"), (4, "green tea green tea"), (5, "Green TEA"), (6, "x" * 200_000), (6, "twice"), (None, "no key")]
    posts = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {(r.doc_id, r.topic_label[:9]) for r in enrich.extract_topic(posts, "doc_id").collect()}
    assert {(1, "unknown"), (2, "unknown"), (3, "unknown"), (4, "green"), (5, "green")} <= got
    assert enrich.extract_topic(posts.limit(0), "doc_id").count() == 0


def test_results_of_two_calls_can_be_read_side_by_side(lake):
    queries = catalog.QUERIES
    for name in ("extract_topic", "post_explorer", "search_posts", "refresh_outcome"):
        one, two = queries[name](lake), queries[name](lake)
        assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
