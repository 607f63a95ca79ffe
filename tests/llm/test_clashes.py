"""Filtering stages leave a user's columns alone, whatever their names."""

from pyspark.sql import functions as F

from chatterlake.llm import decontaminate, exact_dedup, simhash

NAMES = ["row", "row_", "ROW__", "text_sha256", "text_sha256_", "keep_id", "keep_id_", "rank", "rank_", "dropped_id",
         "dropped_id_", "fp", "component", "item", "term"]


def test_columns_pass_through(spark):
    words = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, words), (2, words.upper()), (3, "other " + words), (4, "quite another text of seven words"), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs = docs.select("*", *[(F.col("doc_id") * 10 + i).alias(n) for i, n in enumerate(NAMES)])
    items = spark.createDataFrame([(7, "eleven twelve")], "item_id long, text string")
    kept = {
        "exact": (exact_dedup.drop_exact_duplicates(docs), {2, 3, 4, 5}),
        "near": (simhash.drop_near_duplicates(docs), None),
        "clean": (decontaminate.drop_contaminated(docs, items), {4, 5}),
    }
    for df, ids in kept.values():
        assert df.columns == docs.columns and df.dtypes == docs.dtypes
        found = df.collect()
        assert ids is None or {r.doc_id for r in found} == ids
        for r in found:
            assert list(r)[2:] == [r.doc_id * 10 + i for i in range(len(NAMES))]
