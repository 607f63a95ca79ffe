"""Bucketed layers: one bucket a look-up, no exchange of texts in the gold join."""

import re

from pyspark.sql import functions as F

from chatterlake import storage
from chatterlake.operators import gold as G
from chatterlake.operators import keyed, serve


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_lookup_opens_one_bucket(spark, lake):
    found = serve.lookup(lake.keyed("silver_posts", "id"), id=123)
    assert found.select("_metadata.file_path").distinct().count() == 1
    scan = found._jdf.queryExecution().sparkPlan().collectLeaves().apply(0)
    details = scan.metadata().apply("SelectedBucketsCount"), scan.metadata().apply("PushedFilters")
    assert details == ("1 out of 8", "[IsNotNull(id), EqualTo(id,123)]")


def test_texts_are_joined_where_they_lie(spark, lake):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        silver, side = lake.keyed("silver_posts", "id"), lake.keyed("silver_ai_enrichment", "silver_post_id")
        post = G._enrichment_side(side)
        assert "Exchange" not in plan_of(silver.join(post, "id", "left").select("id", "post_text", "sentiment"))
        stored = lake.gold_post_search.filter(F.col("id") % 2 == 0)
        text = plan_of(G.gold_post_search_all_versions(silver, side, lake.search_requests.limit(0), stored).drop("keyword"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    moved = [line for line in text.splitlines() if re.search(r"Exchange hashpartitioning", line)]
    assert any("text_sha256" in line for line in moved) and not any("post_text" in line for line in moved)


def test_odd_keys(spark):
    rows = [(1, "a"), (1, "b"), (None, "c"), (2, None)]
    table = keyed.write_keyed(spark.createDataFrame(rows, "id long, v string"), storage.fresh_path(spark, "keyed"), "id", 4)
    assert sorted(map(str, map(tuple, table.collect()))) == sorted(map(str, rows))
    assert {r.v for r in serve.lookup(table, id=1).collect()} == {"a", "b"}
    empty = keyed.write_keyed(table.limit(0), storage.fresh_path(spark, "keyed"), "id", 4)
    assert empty.count() == 0 and empty.columns == ["id", "v"]
