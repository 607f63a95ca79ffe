"""The corpus pipeline against its stages written out by brute force."""

import corpus_pipeline
import numpy as np
from test_decontaminate import brute
from test_simhash import slow_components, slow_fingerprint
from tokenizers import Tokenizer

from chatterlake.llm import quality
from chatterlake.llm.queries import quality_weights
from chatterlake.llm.tokens import tokenizer_path

SMALL = "/root/testdata/sf0.001"


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def test_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    weights = quality_weights(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    rows = [(r.doc_id, r.text) for r in quality.score(docs, weights).collect() if r.score >= 0.3]
    last = {}
    for doc_id, text in sorted(rows):
        last[ascii_lower(text)] = (doc_id, text)
    rows = sorted(last.values())
    fps = {i: slow_fingerprint(t) for i, t in rows}
    component = slow_components(fps)
    rows = [(i, t) for i, t in rows if component[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [r for r, b in zip(rows, brute(rows, items)) if not b[-1]]
    plain = Tokenizer.from_file(tokenizer_path())
    expected = {i: [*plain.encode(t, add_special_tokens=False).ids, 0] for i, t in rows}
    got: dict = {}
    for r in sorted(corpus_pipeline.run(spark, SMALL).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    assert got == expected
    assert 0 < len(rows) < docs.count()


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(20), SMALL)
        assert out.schema == docs.schema
        assert stage(spark, docs.limit(0), SMALL).count() == 0
