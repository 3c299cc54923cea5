"""Incremental ingest as streams (an extension: the batch operators are the reference behaviour)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.store import queue_changed


def file_changes(spark: SparkSession, folder: str, delay: str = "1 day") -> DataFrame:
    """A stream of (repo_id, target, content_hash, seen_at) with each content of a file once within ``delay``."""
    rows = spark.readStream.schema("repo_id string, target string, content_hash string, seen_at timestamp").json(folder)
    return rows.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["repo_id", "target", "content_hash"])


def queue_stream(changes: DataFrame, read_jobs: Callable[[], DataFrame], write_jobs: Callable[[DataFrame], None], checkpoint: str):
    """Turn each micro-batch into the next version of the job table; a batch that is run again gives the same version."""

    def apply(batch: DataFrame, _: int) -> None:
        newest = batch.groupBy("repo_id", "target").agg(F.max_by("content_hash", "seen_at").alias("content_hash"))
        write_jobs(queue_changed(read_jobs(), newest))

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Job events by status and hour, for a stream or a table."""
    timed = events.withWatermark("created_at", delay) if events.isStreaming else events
    return timed.groupBy(F.window("created_at", width), "status").agg(F.count("*").alias("n"))
