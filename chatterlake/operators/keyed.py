"""Tables bucketed and sorted by an id.

Rows of one id lie in one bucket: a look-up opens the files of one bucket, in which the sort order and a Bloom
filter per row group leave little to read, and tables with equal buckets are joined by id where they lie.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

BUCKETS = 64


def write_keyed(df: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` in ``buckets`` buckets by ``key`` and read it back as a table of the session's catalog.

    Every task holds whole buckets, so there is one file a bucket. Choose the number by size, some hundred
    megabytes a bucket, and the same one for tables that are joined by the key. A NULL key is a bucket like
    any other; look-ups and joins by equality do not find it.
    """
    spark = df.sparkSession
    name = f"keyed_{uuid.uuid4().hex}"
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
     .option("path", path).option(f"parquet.bloom.filter.enabled#{key}", "true").saveAsTable(name))
    return spark.table(name)
