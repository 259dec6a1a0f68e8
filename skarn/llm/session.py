"""What the operators need of a session: tables, shuffle width and the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skarn.operators.lineage import Scratch, cut, shared_folder  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session is set."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder, whatever its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
