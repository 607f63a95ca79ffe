"""Every operator as a named query over a lake, next to the SQL that gives the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chatterlake.catalog.registry import ORACLES, QUERIES
from chatterlake.plans.lake import Lake

from chatterlake.catalog import (  # noqa: F401  (importing registers the queries)
    aggregates, enrichment, ingest, joins, lifecycle, quality, serving, streams,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(run: Callable[[Lake], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, source_dir: run(Lake(spark, source_dir))

    return {name: bind(run) for name, run in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
