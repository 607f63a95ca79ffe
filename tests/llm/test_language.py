"""Held-out accuracy, mixtures and odd rows of the language model."""

import numpy as np

from chatterlake.llm import language, queries

MEDIUM = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    rows = queries.QUERIES["op4_language"](spark, MEDIUM).collect()
    lang = {r.doc_id: r.lang for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(lang)
    held = [r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]
    assert len(held) > 150 and np.mean(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_mixture_and_odd_rows(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    model = language.train(docs)
    assert model.languages == ["de", "en", "es", "fr"]
    text = {}
    for r in docs.where("n_chars > 2500").collect():
        text.setdefault(r.lang, r.text[:2000])
    found = dict(language.identify(text["de"] + " " + text["fr"], model))
    assert set(found) == {"de", "fr"} and abs(found["de"] - 0.5) < 0.12
    assert [x[0] for x in language.identify(text["es"], model)] == ["es"]
    rows = [(1, None), (2, ""), (3, "123 ?! ½"), (None, text["en"]), (5, text["en"] * 60), (5, text["en"] * 60), (6, "a")]
    odd = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang_pred string")
    got = language.predict(odd, model)
    by_id = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(rows)
    assert [(by_id[i].lang_pred, by_id[i].score, by_id[i].languages) for i in (1, 2, 3)] == [("und", 0.0, [])] * 3
    assert by_id[None].lang_pred == by_id[5].lang_pred == "en" and by_id[6].lang_pred in model.languages
    assert language.predict(odd.limit(0), model).count() == 0
    none = language.train(docs.limit(0))
    assert none.languages == [] and {r.lang_pred for r in language.predict(odd, none).collect()} == {"und"}


def test_shares_by_hand():
    # trigram 0 is twice as likely in the first language; 3 of 4 seen are trigram 0
    likelihood = np.array([[1.0, 0.0], [0.0, 1.0]], np.float32) * 0.999 + 0.0005
    share, _ = language.mixture(likelihood, np.array([3.0, 1.0], np.float32), 200)
    assert np.allclose(share, [0.75, 0.25], atol=0.01)


def test_more_than_four_languages(spark):
    # a language set ended at four languages
    letters = ["abcdef", "ghijkl", "mnopqr", "stuvwx", "αβγδεζ", "абвгде"]
    text = {f"l{i}": "".join(s[j % 6] + s[j * j % 5] + s[j // 6 % 6] + " " * (j % 2) for j in range(200)) for i, s in enumerate(letters)}
    docs = spark.createDataFrame([(i, *x) for i, x in enumerate(text.items())], "doc_id long, lang string, text string")
    model = language.train(docs)
    found = dict(language.identify(" ".join(text.values()), model))
    # a letter of two bytes counts twice: shares of an eighth and a quarter
    assert set(found) == set(text) and abs(sum(found.values()) - 1) < 1e-3 and 0.12 < min(found.values()) < 0.13
    assert [x[0] for x in language.identify(text["l4"], model)] == ["l4"]
