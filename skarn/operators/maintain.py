"""Incremental maintenance: change detection, removal, upserts and last-writer-wins merges, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.lineage import cut


def last_writer(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of every key by the order columns, nulls first; an aggregate that combines before the shuffle."""
    last = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(key))).agg(last.alias("_last")).select("_last.*")


def change_scan(tracked: DataFrame, disk: DataFrame, key: str = "path", stamp: str = "mtime_ms") -> DataFrame:
    """(key, status) of what differs: new, changed (strictly newer) or deleted.

    tracked and disk hold one row per key with its stamp; equal and older stamps are unchanged.
    """
    a = tracked.select(F.col(key), F.col(stamp).alias("_had"))
    b = disk.select(F.col(key), F.col(stamp).alias("_has"))
    status = F.when(F.col("_had").isNull(), "new").when(F.col("_has").isNull(), "deleted").when(F.col("_has") > F.col("_had"), "changed")
    return a.join(b, key, "full").select(key, status.alias("status")).where("status is not null")


def deleted(tracked: DataFrame, disk: DataFrame, key: str = "path") -> DataFrame:
    return tracked.join(disk, key, "left_anti")


#: Keys are broadcast up to so many; more of them meet the facts in a shuffle.
BROADCAST_KEYS = 100_000


def without(facts: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Facts of the keys that are not gone; the facts, which may hold long texts, are not shuffled for a few keys."""
    keys = gone.select(key).distinct()
    if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return facts.join(keys, key, "left_anti")


def replace(facts: DataFrame, fresh: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """Re-indexing: facts of touched keys give way to fresh ones; repeating it changes nothing."""
    return without(facts, touched, key).unionByName(fresh)


def insert_absent(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows, and those new ones whose key is not there yet."""
    return rows.unionByName(new.join(rows.select(key), key, "left_anti").select(*rows.columns))


def intern(paths: DataFrame, registry: DataFrame | None = None, path: str = "path") -> DataFrame:
    """(file_id, path) of a registry with the new paths added, ids dense from 0 in path order after the known ones."""
    new = paths.select(F.col(path).alias("path")).where("path is not null").distinct()
    first = 0
    if registry is not None:
        new = new.join(registry.select("path"), "path", "left_anti")
        top = registry.agg(F.max("file_id")).first()[0]
        first = 0 if top is None else top + 1
    spread = new.repartitionByRange("path").withColumn("_part", F.spark_partition_id())
    spread = cut(spread)
    sizes = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row per partition
    w = Window.partitionBy("_part").orderBy("path")
    fresh = spread.join(F.broadcast(before), "_part").select((F.lit(first) + F.col("_before") + F.row_number().over(w) - 1).cast("int").alias("file_id"), "path")
    return fresh if registry is None else registry.select("file_id", "path").unionByName(fresh)


def needs_rebatch(edits: DataFrame, project: str = "project", file: str = "path", after: int = 20) -> DataFrame:
    """Projects with at least `after` distinct files edited one by one."""
    return edits.groupBy(project).agg(F.countDistinct(file).alias("edited")).withColumn("rebatch", F.col("edited") >= after)
