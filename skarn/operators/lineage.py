"""Cutting lineage in the checkpoint folder that all executors share."""

from __future__ import annotations

import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="skarn-checkpoint-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and keeps it in the shared folder, so that lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(True)


@contextmanager
def freed_shuffles(spark: SparkSession):
    """Queries that run in here leave no shuffle files: each one's go when it ends."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


class Scratch:
    """A folder of ORC tables in the shared folder (its codecs work on the heap): droppable one by one, gone with the session.

    A kept table cuts lineage as a checkpoint does.  The shuffle files of the query that made it are freed at
    once, since nothing refers to them any more.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.at = spark, f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        path, fs = self._path(self.at)
        fs.mkdirs(path)
        fs.deleteOnExit(path)

    def _path(self, at: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with freed_shuffles(self.spark):
            df.write.orc(f"{self.at}/{name}")
        gc.collect()  # lets go of the driver's plans and broadcasts of frames that are out of use
        return self.spark.read.schema(df.schema).orc(f"{self.at}/{name}")

    def drop(self, name: str | None = None) -> None:
        """Deletes one table, or the whole folder."""
        path, fs = self._path(f"{self.at}/{name}" if name else self.at)
        fs.delete(path, True)
