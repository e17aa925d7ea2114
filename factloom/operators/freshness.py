"""What changed between two inventories, whether a result is still current, and how to refresh it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _diff(before: DataFrame, after: DataFrame, changed: Column, columns: tuple[str, ...]) -> DataFrame:
    a = before.select("path", *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("was"))
    b = after.select("path", *columns, F.lit(True).alias("is"))
    state = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(changed, "changed")
    return a.join(b, "path", "full_outer").select("path", state.alias("state")).where("state IS NOT NULL")


def stat_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state) of added, deleted and changed files, told by size and time; contents are not read."""
    moved = (F.col("size") != F.col("old_size")) | (F.col("mtime_ns") != F.col("old_mtime_ns"))
    return _diff(before, after, moved, ("size", "mtime_ns"))


def content_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """The same, told by content hash."""
    return _diff(before, after, F.col("sha256") != F.col("old_sha256"), ("sha256",))


def _counts(diff: DataFrame) -> DataFrame:
    of = lambda s: F.coalesce(F.sum((F.col("state") == s).cast("long")), F.lit(0)).alias(s)
    return diff.agg(of("added"), of("deleted"), of("changed"))


def freshness(diff: DataFrame, *, ready: bool = True, target_exists: bool = True, config_changed: bool = False) -> DataFrame:
    """One row: freshness, and how many files were added, deleted and changed."""
    state = F.when(F.lit(not ready), "building").when(F.lit(not target_exists), "failed")
    state = state.when((F.col("added") + F.col("deleted") + F.col("changed") > 0) | F.lit(config_changed), "stale").otherwise("current")
    return _counts(diff).select(state.alias("freshness"), "added", "deleted", "changed")


def refresh_plan(diff: DataFrame, *, previous: bool = True, config_changed: bool = False, aliases_changed: bool = False) -> DataFrame:
    """One row: mode, the first reason that holds, and the counts of a content diff."""
    reason = (
        F.when(F.lit(not previous), "no_previous_manifest").when(F.col("added") > 0, "added_files").when(F.col("deleted") > 0, "deleted_files")
        .when(F.lit(config_changed), "config_changed").when(F.lit(aliases_changed), "import_aliases_changed").otherwise("compatible_cache")
    )
    return _counts(diff).withColumn("reason", reason).select(
        F.when(F.col("reason") == "compatible_cache", "incremental").otherwise("full").alias("mode"), "reason", "added", "deleted", "changed"
    )


def reused_fingerprints(before: DataFrame, after: DataFrame, fresh: Column) -> DataFrame:
    """after with its content hash: the earlier one where size and time agree, else ``fresh``, which may read the content."""
    old = before.select("path", F.col("size").alias("old_size"), F.col("mtime_ns").alias("old_mtime_ns"), F.col("sha256").alias("old_sha256"))
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime_ns") == F.col("old_mtime_ns"))
    return after.join(old, "path", "left").select(
        "path", "size", "mtime_ns", F.when(same, F.col("old_sha256")).otherwise(fresh).alias("sha256"), F.coalesce(same, F.lit(False)).alias("reused")
    )


def extraction_work(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files that the cache (path, sha256, key) doesn't hold under the same key."""
    return files.join(cache, ["path", "sha256", "cache_key"], "left_anti")
