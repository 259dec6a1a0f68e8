"""Projects and the files that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A table of projects is broadcast up to so many rows; a larger one is shuffled, and skewed prefixes split by AQE.
BROADCAST_ROWS = 100_000


def _plain(path: Column) -> Column:
    """Without slashes at the end; the root is empty."""
    return F.rtrim(path, F.lit("/"))


def prefixes(path: Column) -> Column:
    """A path and all folders above it, at component boundaries only: /a/b gives '', /a and /a/b."""
    parts = F.split(_plain(path), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def owners(paths: DataFrame, projects: DataFrame, path: str = "path") -> DataFrame:
    """(path, project): for each distinct path, the project that holds it; the first by name where several do.

    projects: (name, path).  A path is looked up by its own prefixes, an equi-join for any number of projects, so
    that /p never takes /pq.  Paths outside all projects and null paths have no row.
    """
    known = projects.where("name IS NOT NULL AND path IS NOT NULL").select(F.col("name").alias("project"), _plain(F.col("path")).alias("_prefix"))
    known = known.groupBy("_prefix").agg(F.min("project").alias("project"))
    if not projects.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        known = F.broadcast(known)
    own = paths.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct()
    return own.withColumn("_prefix", F.explode(prefixes(F.col("path")))).join(known, "_prefix").groupBy("path").agg(F.min("project").alias("project"))


def of_project(files: DataFrame, projects: DataFrame, name: str, path: str = "path") -> DataFrame:
    """The files of one project; none for an unknown one."""
    mine = owners(files, projects, path).where(F.col("project") == name).select(F.col("path").alias("_mine"))
    return files.join(mine, F.col(path) == F.col("_mine"), "left_semi")
