"""Java source trees and other inputs as DataFrames of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FILES = "path string, mtime_ms long, content string"


def _raw(spark: SparkSession, root: str) -> DataFrame:
    """(path, mtime_ms, content or null) of the files of a tree; content is null where it is not UTF-8."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.java").option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)
    path = F.col("path")
    keep = ~path.endswith(".qute.java") & ~path.contains("/target/") & ~path.contains("/build/")
    return read.load(root).where(keep).select(path, F.unix_millis("modificationTime").alias("mtime_ms"), F.try_validate_utf8(F.col("content").cast("string")).alias("content"))


def source_tree(spark: SparkSession, root: str) -> DataFrame:
    """FILES of every .java file below root, but templates (.qute.java) and build output.

    Files that vanish or cannot be read while they are scanned, and those that are no UTF-8 text, are left out.
    """
    return _raw(spark, root).where("content is not null")


def unreadable(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the files that source_tree leaves out because they are no UTF-8 text."""
    return _raw(spark, root).where("content is null").select("path")


def in_memory(spark: SparkSession, files: list[tuple[str, str]], mtime_ms: int = 0) -> DataFrame:
    """FILES from (path, source) pairs, without a disk."""
    return spark.createDataFrame([(p, mtime_ms, c) for p, c in files], FILES)


def to_uri(path):
    """file: URI of a path; a URI stays."""
    return F.when(path.startswith("file:"), path).otherwise(F.concat(F.lit("file://"), F.replace(path, F.lit(" "), F.lit("%20"))))


def from_uri(uri):
    """Path of a file: URI; anything else stays as it is."""
    return F.when(uri.startswith("file:"), F.try_url_decode(F.replace(F.regexp_replace(uri, "^file:(//)?", ""), F.lit("+"), F.lit("%2B")))).otherwise(uri)
