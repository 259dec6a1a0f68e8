"""Continuous refresh: a stream of changed files is merged into stored facts, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skarn.operators.javaparse import extract
from skarn.operators.lineage import cut
from skarn.operators.maintain import last_writer
from skarn.sources.buckets import BucketStore


def latest(changes: DataFrame) -> DataFrame:
    """The last change of every path of a batch of changes(path, mtime_ms, kind, content)."""
    return last_writer(changes, ["path"], ["mtime_ms"])


def merge_facts(stored: DataFrame | None, changes: DataFrame) -> DataFrame:
    """Stored FACTS with those of changed paths replaced, and those of removed ones gone."""
    now = latest(changes)
    fresh = extract(now.where("kind <> 'FILE_REMOVED'"))
    return fresh if stored is None else stored.join(now.select("path"), "path", "left_anti").unionByName(fresh)


def facts_store(spark: SparkSession, path: str, buckets: int = 256) -> BucketStore:
    """FACTS in buckets by their file."""
    return BucketStore(spark, path, {"facts": "path"}, {"facts": ["rel", "name"]}, buckets)


def follow(changes: DataFrame, store: str, checkpoint: str, every: str = "30 seconds", on_batch: Callable[[int, DataFrame], None] | None = None, once: bool = False, buckets: int = 256) -> StreamingQuery:
    """Commits each micro-batch to the facts below store: only the buckets of its files are rewritten.

    The manifest keeps the epoch, so a batch that is repeated after a failure is not committed twice.
    """

    def commit(batch: DataFrame, epoch: int) -> None:
        s = facts_store(batch.sparkSession, store, buckets)
        now = s.manifest()
        if now is None or now["note"]["epoch"] < epoch:
            seen = cut(latest(batch))
            fresh = cut(extract(seen.where("kind <> 'FILE_REMOVED'")))
            s.commit({"facts": (fresh, seen.select(F.col("path").alias("key")))}, now["version"] if now else 0, {"epoch": epoch})
        if on_batch:
            on_batch(epoch, s.read("facts"))

    w = changes.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def current(spark: SparkSession, store: str) -> DataFrame | None:
    """The facts as last committed."""
    return facts_store(spark, store).read("facts")


def edits_per_project(changes: DataFrame, window: str = "30 seconds", late: str = "2 minutes") -> DataFrame:
    """Distinct files edited per project and window of event time, for the rebatch rule."""
    return changes.withWatermark("ts", late).groupBy(F.window("ts", window), "project").agg(F.size(F.collect_set("path")).cast("long").alias("edited"))
