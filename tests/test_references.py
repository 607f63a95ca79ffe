"""Stored posts refer to their texts; texts are read last and are neither shuffled nor written per post."""

import re

from conftest import SMALL
from pyspark.sql import functions as F

from chatterlake import catalog
from chatterlake.plans.lake import Lake
from chatterlake.plans.refresh import full_refresh


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_layers_hold_references(lake):
    for name, column in [("bronze_refs", "raw_payload"), ("post_facts", "post_text"), ("gold_refs", "post_text")]:
        fields = lake.layer(name).schema[column].dataType.fieldNames()
        assert fields == ["event_id", "ts", "user_id", "event_type", "value", "doc_id", "doc_hash"]


def test_documents_are_left_alone_where_no_text_is_used(lake):
    for name in ("bronze_posts", "silver_posts", "gold_post_search"):
        assert "documents.parquet" not in plan_of(lake.layer(name).groupBy("platform").count())
    assert "documents.parquet" in plan_of(lake.gold_post_search.select(F.md5("post_text")))


def test_no_text_of_a_post_is_shuffled(spark, lake):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = lake.gold_post_search.select("id", F.md5("post_text"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # the texts are built above all exchanges
    assert "Exchange" in plan and "from_json" in plan
    assert not re.search("from_json|to_json", plan[plan.index("Exchange"):])


def test_new_silver_posts_are_picked_before_their_payloads_are_read(spark):
    """With large tables on both sides the posts are shuffled to be picked, as references."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(catalog.queries()["bronze_to_silver_new"](spark, SMALL))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in plan and "to_json" in plan.replace("StructsToJsonEvaluator", "to_json")
    assert not re.search("from_json|to_json|StructsToJson", plan[plan.index("Exchange"):])


def test_a_refresh_of_references_equals_one_of_payloads(spark, lake, tmp_path):
    """Its tables hold references; texts are put back in what it returns."""
    at = F.lit("2024-02-01").cast("timestamp_ntz")
    plain = full_refresh(lake.raw_posts, lake.search_requests, at, f"{tmp_path}/plain")
    refs = full_refresh(lake.raw_refs, lake.search_requests, at, f"{tmp_path}/refs", lake.with_payloads, lake.with_texts)
    for table in ("scored_posts", "gold_posts"):
        stored = spark.read.parquet(f"{tmp_path}/refs/{table}").schema["post_text"].dataType
        assert "doc_id" in stored.fieldNames()
    for name in ("bronze", "silver", "posts", "daily"):
        a, b = getattr(plain, name), getattr(refs, name)
        assert a.columns == b.columns and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_documents_and_events_with_equal_ids(spark, tmp_path):
    """Post 7 may be any of four rows; its text and tags come from one of them."""
    docs = [(i, f"text {i} #t{i}", "en", "web", 10) for i in range(4)] + [(3, "other #o", "fr", "book", 8)]
    events = [(i, i, "click", 1.0) for i in range(10)] + [(7, 71, "view", 2.0), (None, 5, "view", 2.0)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    spark.createDataFrame(events, "event_id long, user_id long, event_type string, value double").withColumn(
        "ts", F.lit("2024-01-05").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = Lake(spark, str(tmp_path))
    raw = {(r.id, r.raw_payload) for r in odd.raw_posts.collect()}
    bronze = [(r.id, r.raw_payload) for r in odd.bronze_posts.collect()]
    assert len(bronze) == len({i for i, _ in bronze}) == 8 and set(bronze) <= raw  # id % 5 = 4 has no document
    text = {r.id: r.post_text for r in odd.silver_posts.collect()}
    assert text == {i: p for i, p in text.items() if p} and len(text) == 8
    facts = {r.id: (r.hashtags, r.author_handle) for r in odd.post_facts.collect()}
    for i, (tags, handle) in facts.items():
        found = re.findall(r"#(\w+)", text[i])
        assert {t.lower() for t in found} <= {t.lower() for t in tags}
        user = re.search(r"@u(\d+)", text[i])
        assert user is None or handle in (None, f"u{user[1]}")
    gold = {r.id: r.post_text for r in odd.gold_post_search.collect()}
    assert gold == text


def test_gold_posts_are_shuffled_for_the_join_only(spark, lake, tmp_path, monkeypatch):
    """With few campaigns the tasks of the join write the files, with many the posts are rebalanced first."""
    hints = []
    hint = type(lake.gold_refs).hint
    monkeypatch.setattr(type(lake.gold_refs), "hint", lambda df, *h: hints.append(h) or hint(df, *h))
    rows = []
    for name, files in [("few", 64), ("many", 0)]:
        monkeypatch.setattr("chatterlake.plans.lake.FILES_PER_TASK", files)
        (tmp_path / name).symlink_to("/root/testdata/sf0.001")
        gold = Lake(spark, str(tmp_path / name)).gold_refs
        rows.append(sorted((r.id, r.search_request_id, r.text) for r in gold.select(
            "id", "search_request_id", F.to_json("post_text").alias("text")).collect()))
        assert ("rebalance", "search_request_id") not in hints if name == "few" else hints
    assert rows[0] == rows[1] and len(rows[0]) > 900


def test_a_page_reads_its_own_documents(lake):
    """Of the documents, those that the page names are grouped; the others are dropped before they are shuffled."""
    from chatterlake.operators import serve

    page = serve.search_posts(lake.gold_refs, 5, 2, lake.fresh("page"), lake.with_texts, lake.with_texts_of, keyword="an")
    plain = serve.search_posts(lake.gold_post_search, 5, 2, keyword="an")
    assert page.rows.collect() == plain.rows.select(*page.rows.columns).collect()
    assert page.total.collect() == plain.total.collect()
    assert "LeftSemi" in plan_of(page.rows) and len(page.rows.collect()) == 5
