"""Keeping a bundle current: a poll loop, and a stream of inventories for tables that grow.

``watch`` looks at names, sizes and times at an interval and refreshes when they
moved. ``fingerprint_stream`` does for a streamed inventory what ``status`` does
for a listed one: each micro-batch is compared with the fingerprints so far and
its news are added to them.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import freshness
from factloom.plans import engine

INTERVAL = 2.0


def watch(spark: SparkSession, output: str, *, interval: float = INTERVAL, rounds: int | None = None, tell: Callable[[dict], None] = print) -> int:
    """Refreshes whenever the bundle is stale; endless unless rounds are given. How often it refreshed."""
    done = n = 0
    while rounds is None or n < rounds:
        n += 1
        if engine.status(spark, output)["freshness"] == "stale":
            tell(engine.refresh(spark, output)["refresh"])
            done += 1
        if rounds is None or n < rounds:
            time.sleep(interval)
    return done


def fingerprint_stream(inventories: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Starts a query over (path, size, mtime_ns, sha256); writes each batch's (path, state, batch) below folder/changes.

    folder/state holds one version a batch, so a batch that is run again after a failure replaces its own.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy("path").agg(F.max_by(F.struct("size", "mtime_ns", "sha256"), "mtime_ns").alias("f")).select("path", "f.*")
        before = spark.read.schema(latest.schema).parquet(f"{folder}/state/v{number - 1}") if number else spark.createDataFrame([], latest.schema)
        news = freshness.content_diff(before, latest).where("state <> 'deleted'")
        news.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/changes/v{number}")
        before.join(latest.select("path"), "path", "left_anti").unionByName(latest).write.mode("overwrite").parquet(f"{folder}/state/v{number}")

    return inventories.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
