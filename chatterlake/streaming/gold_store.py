"""Gold tables that a stream keeps up by merging into partitions of campaign and day.

Every batch writes a new version of the partitions it touches, of their parts and daily rows, and of the
summaries of their campaigns. The last write of a batch is its manifest: which version of each
partition counts. A batch that is run again replaces its own version and starts from the manifest
before it, so a crash at any point leaves the old state or the new one. Reads join the manifest, which
prunes to the partitions that count; nothing is ranked. :meth:`GoldStore.vacuum` removes what no
manifest names any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chatterlake import storage
from chatterlake.operators import gold as G
from chatterlake.operators import partials as P

PLACE = ["part_campaign", "part_day"]


def _part_campaign() -> Column:
    """Folder name of a campaign: never empty or NULL, which Hive-style folders cannot tell apart."""
    return F.coalesce(F.concat(F.lit("c-"), "search_request_id"), F.lit("none"))


def _part_day(date: Column) -> Column:
    return F.coalesce(date.cast("string"), F.lit("none"))


class GoldStore:
    def __init__(self, spark: SparkSession, root: str, requests: DataFrame, at: Column | None = None) -> None:
        self.spark, self.root, self.requests, self.at = spark, root.rstrip("/"), requests, at

    # --- reading ------------------------------------------------------------------------------

    def _manifests(self) -> list[int]:
        """Batches whose manifest is complete, in their order."""
        folder = f"{self.root}/manifest"
        names = [n for n in storage.children(self.spark, folder) if n.startswith("version=")]
        return sorted(int(n.split("=")[1]) for n in names if "_SUCCESS" in storage.children(self.spark, f"{folder}/{n}"))

    def _manifest(self, version: int | None) -> DataFrame | None:
        if version is None:
            return None
        return self.spark.read.parquet(f"{self.root}/manifest/version={version}").withColumnRenamed("at_version", "version")

    def _rows(self, table: str, keys: list[str], manifest: DataFrame) -> DataFrame:
        """Rows of the versions that count."""
        # the comparison lets the manifest prune folders
        valid = manifest.filter(F.col("version") >= 0).filter(F.col("level") == ("campaign" if len(keys) == 1 else "day"))
        stored = self.spark.read.option("mergeSchema", "false").parquet(f"{self.root}/{table}")
        stored = stored.withColumns({c: F.col(c).cast("string") for c in keys} | {"version": F.col("version").cast("bigint")})
        return stored.join(valid.select(*keys, "version"), [*keys, "version"]).drop("version", *PLACE)

    def _current(self) -> DataFrame:
        found = self._manifests()
        if not found:
            raise FileNotFoundError(f"no batch is stored in {self.root}")
        return self._manifest(found[-1])

    def posts(self) -> DataFrame:
        """One row per post."""
        return self._rows("posts", PLACE, self._current())

    def daily(self) -> DataFrame:
        """Daily table with its top lists."""
        return self._rows("daily", PLACE, self._current())

    def summary(self) -> DataFrame:
        """Summary of every campaign that a post has reached."""
        return self._rows("summary", PLACE[:1], self._current())

    # --- writing ------------------------------------------------------------------------------

    def _write(self, rows: DataFrame, table: str, version: int, folders: list[str]) -> None:
        (rows.hint("rebalance", *folders).write.mode("overwrite").partitionBy(*folders)
         .parquet(f"{self.root}/{table}/version={version}"))

    def merge(self, posts: DataFrame, version: int) -> None:
        """Insert or replace gold posts by id; of a batch's rows with one id the newest counts.

        A post keeps its campaign and day: both come from the payload that its id names. Versions must rise; the
        last one may be merged again.
        """
        earlier = self._manifests()
        if earlier and earlier[-1] > version:
            raise ValueError(f"batch {earlier[-1]} is stored in {self.root}, {version} is older")
        base = self._manifest(max((v for v in earlier if v < version), default=None))
        newest = Window.partitionBy("id").orderBy(F.desc("created_at"), F.desc("ai_version"))
        placed = posts.withColumns({"part_campaign": _part_campaign(), "part_day": _part_day(F.to_date("posted_at"))})
        incoming = storage.write_table(
            placed.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank"),
            f"{self.root}/incoming/version={version}")
        touched = storage.write_table(incoming.select(*PLACE).distinct(), f"{self.root}/touched/version={version}")
        merged = incoming
        if base is not None:
            known = base.filter("level = 'day'").join(touched, PLACE, "left_semi")
            stored = (self._rows_with_place(known).join(incoming.select("id"), "id", "left_anti"))
            merged = stored.select(*incoming.columns).unionByName(incoming)
        self._write(merged, "posts", version, PLACE)
        if touched.isEmpty():  # folders of an empty version hold no file to read a schema from
            return self._commit(base, touched, version)
        now = self.spark.read.schema(incoming.schema).parquet(f"{self.root}/posts/version={version}")
        place = {"part_campaign": _part_campaign(), "part_day": _part_day(F.col("date"))}
        parts, items = P.day_parts(now), P.item_parts(now)
        self._write(parts.withColumns(place), "parts", version, PLACE)
        self._write(items.withColumns(place), "items", version, PLACE)
        new_parts, new_items = (self.spark.read.parquet(f"{self.root}/{t}/version={version}") for t in ("parts", "items"))
        self._write(P.daily_of(new_parts, new_items, at=self.at).withColumns(place), "daily", version, PLACE)
        manifest = self._next_manifest(base, touched, version)
        campaigns = touched.select("part_campaign").distinct()
        of_campaigns = manifest.join(campaigns, "part_campaign", "left_semi")
        all_parts, all_items = (self._rows(t, PLACE, of_campaigns) for t in ("parts", "items"))
        requests = self.requests.withColumn("search_request_id", F.col("id")).withColumn(
            "part_campaign", _part_campaign()).join(campaigns, "part_campaign", "left_semi")
        self._write(P.summary_of(all_parts, all_items, requests, at=self.at).withColumn("part_campaign", _part_campaign()),
                    "summary", version, PLACE[:1])
        self._commit(base, touched, version)

    def _rows_with_place(self, manifest: DataFrame) -> DataFrame:
        rows = self._rows("posts", PLACE, manifest)
        return rows.withColumns({"part_campaign": _part_campaign(), "part_day": _part_day(F.to_date("posted_at"))})

    def _next_manifest(self, base: DataFrame | None, touched: DataFrame, version: int) -> DataFrame:
        """Version of every partition (level day) and campaign (level campaign)."""
        campaigns = touched.select("part_campaign", F.lit("").alias("part_day")).distinct().withColumn("level", F.lit("campaign"))
        fresh = touched.withColumn("level", F.lit("day")).unionByName(campaigns).withColumn(
            "version", F.lit(version).cast("bigint"))
        if base is None:
            return fresh
        return base.join(fresh, ["level", *PLACE], "left_anti").select(*fresh.columns).unionByName(fresh)

    def _commit(self, base: DataFrame | None, touched: DataFrame, version: int) -> None:
        manifest = self._next_manifest(base, touched, version).withColumnRenamed("version", "at_version")
        manifest.write.mode("overwrite").parquet(f"{self.root}/manifest/version={version}")
        for folder in ("incoming", "touched"):
            storage.discard(self.spark, f"{self.root}/{folder}")

    def vacuum(self) -> None:
        """Remove manifests before the last one and all partitions that it does not name."""
        current = self._current()
        last = self._manifests()[-1]
        for table, keys in [("posts", PLACE), ("parts", PLACE), ("items", PLACE), ("daily", PLACE), ("summary", PLACE[:1])]:
            stored = self.spark.read.parquet(f"{self.root}/{table}")
            folders = stored.select(
                *[F.col(c).cast("string").alias(c) for c in keys], F.col("version").cast("bigint").alias("version"),
                F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct()
            level = "campaign" if len(keys) == 1 else "day"
            stale = folders.join(current.filter(F.col("level") == level), [*keys, "version"], "left_anti")
            for row in stale.select("folder").toLocalIterator():
                storage.discard(self.spark, row.folder)
        for version in self._manifests():
            if version < last:
                storage.discard(self.spark, f"{self.root}/manifest/version={version}")


def gold_sink(store: GoldStore, enrichment: Callable[[], DataFrame]) -> Callable[[DataFrame, int], None]:
    """Batch function that merges the gold rows of the silver posts in the batch."""
    def write(batch: DataFrame, batch_id: int) -> None:
        ids = batch.select(F.col("id").alias("silver_post_id"))
        side = enrichment().join(ids, "silver_post_id", "left_semi")
        store.merge(G.gold_post_search(batch, side, store.requests), batch_id)

    return write
