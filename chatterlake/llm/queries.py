"""The operators as registered queries over the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from chatterlake.llm import alignment, decontaminate, derivatives, exact_dedup, language, merkle, packing, pii, quality, simhash, substring_dedup, topk, wavelet
from chatterlake.llm.common import crc_bucket, table
from chatterlake.storage import fresh_path


def quality_weights(docs: DataFrame, labels: DataFrame):
    """The classifier learnt from labelled documents outside the held-out fifth."""
    return quality.train(docs, labels.where(crc_bucket(F.col("doc_id"), 5) != 0).select(
        "doc_id", F.col("quality").alias("label")))


def op1_quality(spark: SparkSession, source_dir: str) -> DataFrame:
    docs = table(spark, source_dir, "documents")
    weights = quality_weights(docs, table(spark, source_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), weights).select(
        "doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score",
        (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op2_wavelet_shards(spark: SparkSession, source_dir: str) -> DataFrame:
    path = fresh_path(spark, "wavelet-shards")
    wavelet.write_shards(table(spark, source_dir, "documents"), path)
    return wavelet.read_shards(spark, path).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_exact_dedup(spark: SparkSession, source_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, source_dir, "documents"))


def op4_language(spark: SparkSession, source_dir: str) -> DataFrame:
    docs = table(spark, source_dir, "documents")
    bucket = crc_bucket(F.col("doc_id"), 4)
    model = language.train(docs.where(bucket != 2))
    return language.predict(docs, model).select("doc_id", (bucket == 2).alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, source_dir: str) -> DataFrame:
    return packing.pack(table(spark, source_dir, "documents")).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset")


def op6_substring_dedup(spark: SparkSession, source_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, source_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op7_decontaminate(spark: SparkSession, source_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, source_dir, "documents"), table(spark, source_dir, "benchmark"))


def op8_simhash(spark: SparkSession, source_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, source_dir, "documents")).select(
        "doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op9_derivatives(spark: SparkSession, source_dir: str) -> DataFrame:
    return derivatives.derive(derivatives.responses(table(spark, source_dir, "pages")))


def op10_pii(spark: SparkSession, source_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, source_dir, "documents"))


def op11_topk(spark: SparkSession, source_dir: str) -> DataFrame:
    return topk.top_k(table(spark, source_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_alignment(spark: SparkSession, source_dir: str) -> DataFrame:
    return alignment.align(table(spark, source_dir, "documents"))


def op13_merkle(spark: SparkSession, source_dir: str) -> DataFrame:
    return merkle.verified_manifest(table(spark, source_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_wavelet_shards": op2_wavelet_shards,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_language": op4_language,
    "op5_packing": op5_packing,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_simhash": op8_simhash,
    "op9_derivatives": op9_derivatives,
    "op10_pii": op10_pii,
    "op11_topk": op11_topk,
    "op12_alignment": op12_alignment,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_substring_dedup": substring_dedup.ORACLE,
    "op7_decontaminate": decontaminate.ORACLE,
    "op9_derivatives": derivatives.ORACLE,
    "op11_topk": topk.ORACLE,
    "op13_merkle": merkle.ORACLE,
}
