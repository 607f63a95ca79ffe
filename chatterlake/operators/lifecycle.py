"""State changes of stored rows, as functions from tables to new tables."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chatterlake.functions.times import ntz

# Tables under retention with their time column, in deletion order.
RETENTION = {
    "gold_post_search": "created_at",
    "gold_campaign_daily": "created_at",
    "gold_campaign_summary": "created_at",
    "gold_build_tracking": "last_built_at",
    "ai_jobs": "created_at",
    "silver_ai_enrichment": "created_at",
    "silver_posts": "created_at",
    "bronze_posts": "fetched_at",
    "crawl_runs": "started_at",
    "search_requests": "created_at",
}
RETENTION_DAYS = 90
TERMINAL = ["completed", "failed"]


def upsert_requests(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Insert new requests; a known id only takes status, posts_found and updated_at.

    Of several incoming rows of one id the one updated last counts.
    """
    incoming = newest_change(incoming, "updated_at")
    updated = {"status", "posts_found", "updated_at"}
    s, i = stored.alias("s"), incoming.alias("i")
    joined = s.join(i, F.col("s.id") == F.col("i.id"), "full_outer")
    known, sent = F.col("s.id").isNotNull(), F.col("i.id").isNotNull()
    return joined.select(*[
        F.when(sent & (F.lit(c in updated) | ~known), F.col(f"i.{c}"))
        .otherwise(F.col(f"s.{c}")).alias(c)
        for c in stored.columns
    ])


def newest_change(changes: DataFrame, at: str = "at") -> DataFrame:
    """The last change of every id; where times tie or are missing, the greatest row counts."""
    rest = [c for c in changes.columns if c not in ("id", at)]
    order = F.struct(*([at] if at in changes.columns else []), *rest)
    return changes.groupBy("id").agg(F.max(order).alias("_c")).select(
        *["id" if c == "id" else F.col(f"_c.{c}").alias(c) for c in changes.columns]
    )


def _apply(stored: DataFrame, changes: DataFrame, new_values: dict[str, Column]) -> DataFrame:
    """Left-join the newest of ``changes`` by id and replace columns where a change exists."""
    changes = newest_change(changes)
    renamed = changes.select(*[F.col(c).alias(f"_{c}") for c in changes.columns])
    joined = stored.join(renamed, stored["id"] == renamed["_id"], "left")
    hit = F.col("_id").isNotNull()
    return joined.select(*[
        F.when(hit, new_values[c]).otherwise(stored[c]).alias(c) if c in new_values else stored[c]
        for c in stored.columns
    ])


def set_job_status(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (id, status, error_message, at): running starts a job, a terminal state ends it."""
    state = F.col("_status")
    return _apply(jobs, changes, {
        "status": state, "error_message": F.col("_error_message"),
        "started_at": F.when(state == "running", F.col("_at")).otherwise(jobs["started_at"]),
        "completed_at":
            F.when(state.isin(TERMINAL), F.col("_at")).otherwise(jobs["completed_at"]),
    })


def set_run_status(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (id, status, posts_fetched, error_message, at) to crawl runs."""
    state = F.col("_status")
    return _apply(runs, changes, {
        "status": state, "posts_fetched": F.col("_posts_fetched"),
        "error_message": F.col("_error_message"),
        "completed_at":
            F.when(state.isin(TERMINAL), F.col("_at")).otherwise(runs["completed_at"]),
    })


def set_request_status(requests: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (id, status, posts_found, at) to search requests."""
    return _apply(requests, changes, {
        "status": F.col("_status"), "posts_found": F.col("_posts_found"),
        "updated_at": F.col("_at"),
    })


def set_attempts(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (id, attempts)."""
    return _apply(jobs, changes, {"attempts": F.col("_attempts")})


def reset_failed_jobs(jobs: DataFrame, job_type: str | None = None) -> DataFrame:
    """Failed jobs, optionally of one type, wait again. No shuffle."""
    failed = F.col("status") == "failed"
    if job_type is not None:
        failed = failed & (F.col("job_type") == job_type)
    cleared = {
        c: F.when(~failed, F.col(c)) for c in ("error_message", "started_at", "completed_at")
    }
    return jobs.select(*[
        cleared[c].alias(c) if c in cleared
        else F.when(failed, F.lit("pending")).otherwise(F.col(c)).alias(c) if c == "status"
        else F.col(c)
        for c in jobs.columns
    ])


def retention_cutoff(now: str | datetime, days: int = RETENTION_DAYS) -> datetime:
    moment = now if isinstance(now, datetime) else datetime.fromisoformat(now)
    return moment - timedelta(days=days)


def keep_recent(df: DataFrame, time: str, cutoff: datetime) -> DataFrame:
    """Rows that survive a purge; a row without a time is never purged."""
    return df.filter((F.col(time) >= ntz(cutoff)) | F.col(time).isNull())


def purge_counts(tables: dict[str, DataFrame], cutoff: datetime) -> DataFrame:
    """Dry run: rows each table would lose, one narrow scan per table."""
    parts = [
        df.agg(
            F.count_if(F.col(RETENTION[name]) < ntz(cutoff)).alias("purged"),
            F.count(F.lit(1)).alias("rows"),
        ).select(F.lit(name).alias("table_name"), "purged",
                 (F.col("rows") - F.col("purged")).alias("kept"))
        for name, df in tables.items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def purge_expired(tables: dict[str, DataFrame], cutoff: datetime) -> dict[str, DataFrame]:
    """The tables without their expired rows."""
    return {name: keep_recent(df, RETENTION[name], cutoff) for name, df in tables.items()}


def run_metrics(runs: DataFrame, jobs: DataFrame, tracking: DataFrame) -> DataFrame:
    """Counters of crawls, enrichments and gold builds, and errors by type, in long form."""
    def states(df: DataFrame, what: str) -> DataFrame:
        counts = df.agg(
            F.count_if(F.col("status") != "pending").alias(f"{what}_started"),
            F.count_if(F.col("status") == "completed").alias(f"{what}_completed"),
            F.count_if(F.col("status") == "failed").alias(f"{what}_failed"),
        )
        names = [f"{what}_{s}" for s in ("started", "completed", "failed")]
        return counts.unpivot([], names, "counter", "value")

    def errors(df: DataFrame) -> DataFrame:
        return df.filter("error_message IS NOT NULL").groupBy("error_message").agg(
            F.count(F.lit(1)).alias("value")
        )

    by_type = errors(runs).unionByName(errors(jobs)).groupBy("error_message").agg(
        F.sum("value").alias("value")
    )
    builds = tracking.agg(
        F.count(F.lit(1)).alias("value")
    ).select(F.lit("gold_builds_completed").alias("counter"), "value")
    fetched = runs.agg(F.coalesce(F.sum("posts_fetched"), F.lit(0).cast("bigint")).alias("value"))
    return (
        states(runs, "crawls").unionByName(states(jobs, "enrichments")).unionByName(builds)
        .unionByName(fetched.select(F.lit("posts_fetched").alias("counter"), "value"))
        .unionByName(by_type.select(
            F.concat(F.lit("error:"), "error_message").alias("counter"), "value"))
    )
