"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import string
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, source_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{source_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def unused(name: str, df: DataFrame) -> str:
    """A column name like ``name`` that ``df`` does not have, however it is written."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Within the block, Spark hands at most ``rows`` rows at a time to Python: texts can be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def batches(n: int, width: int):
    """Slices that cut ``range(n)`` into blocks of ``width``."""
    return (slice(a, min(a + width, n)) for a in range(0, n, width))
