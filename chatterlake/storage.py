"""Where derived tables are written, and how they are written."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder that every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and
    executors are one process, falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    app = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/chatterlake/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="chatterlake-")
    return _local_roots[app]


def digest(text: str) -> str:
    return hashlib.md5(text.encode()).hexdigest()[:12]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path that no earlier run has used."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that an operator wrote, in whatever store it lies."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in whatever store it lies; empty where there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(target)] if store.exists(target) else []


def write_table(df: DataFrame, path: str, partition_by: str | None = None,
                row_group_mb: int | None = None, rebalance: bool = True, narrow: bool = False,
                marked: bool = False) -> DataFrame:
    """Write Parquet and read it back, which also cuts the lineage.

    A partitioned write first asks for a rebalance on the partition column: small partitions
    share a task, a hot one is split over several, so neither small files nor one giant task. Where tasks are even
    and partitions few, ``rebalance=False`` saves that shuffle: every task writes a file per partition.
    ``row_group_mb`` bounds the row groups of tables whose readers do much work per byte: a file can be
    split between them only. ``narrow`` says that rows are a few numbers each: then two tasks a core, 16 at
    least, write them all, since each file costs more than its rows where shuffles have many partitions.
    ``marked`` leaves the file ``_SUCCESS`` for other readers. Work tables are read once their write has returned and
    do without: the driver makes that file, and on a local disk it starts a process for each file that it makes.
    """
    if narrow:
        df = df.coalesce(max(16, 2 * df.sparkSession.sparkContext.defaultParallelism))
    if partition_by and rebalance:
        df = df.hint("rebalance", partition_by)
    writer = df.write.mode("overwrite").option("compression", "zstd").option(
        "mapreduce.fileoutputcommitter.marksuccessfuljobs", str(marked).lower())
    if partition_by:
        writer = writer.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    if row_group_mb:
        writer = writer.option("parquet.block.size", row_group_mb << 20)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
