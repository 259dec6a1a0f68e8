"""The index on storage: Parquet by default, JSON for exchange.

Each save writes a new version folder and leaves the one before in place, so that an index can be loaded, changed
and saved to the path that it is still read from.  A version counts once its last table is whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("files", "types", "methods", "fields", "type_refs", "name_refs")
#: Diagnostics are not stored; a loaded index has none until its files are indexed again.
DIAGNOSTICS = "file_path string, severity int, message string, line int, col int, start int, end int, code string"


def _fs(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str, whole: bool = True) -> list[int]:
    """Numbers of the stored versions, the oldest first."""
    at, fs = _fs(spark, path)
    if not fs.exists(at):
        return []
    found = [f.getPath() for f in fs.listStatus(at) if f.getPath().getName().startswith("version=")]
    done = lambda p: fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "types/_SUCCESS"))
    return sorted(int(p.getName().split("=")[1]) for p in found if not whole or done(p))


def save(index: dict[str, DataFrame], path: str, form: str = "parquet", dirty: bool = True, force: bool = False) -> bool:
    """Writes the index unless it is clean; references are split by kind, and `types` comes last, as the mark of a whole index."""
    if not (dirty or force):
        return False
    spark = index["types"].sparkSession
    before = versions(spark, path)
    at = f"{path}/version={max(versions(spark, path, whole=False), default=0) + 1}"
    for t in (*(t for t in TABLES if t != "types"), "types"):
        w = index[t].write.mode("overwrite").format(form)
        split = t in ("type_refs", "name_refs") and not index[t].isEmpty()  # a split table without rows would leave no schema
        (w.partitionBy("kind") if split else w).save(f"{at}/{t}")
    for old in before[:-1]:
        clear(spark, f"{path}/version={old}")
    return True


def load(spark: SparkSession, path: str, form: str = "parquet") -> dict[str, DataFrame] | None:
    """The newest whole index, or None where there is none."""
    found = versions(spark, path)
    if not found:
        return None
    out = {t: spark.read.format(form).load(f"{path}/version={found[-1]}/{t}") for t in TABLES}
    return out | {"diagnostics": spark.createDataFrame([], DIAGNOSTICS)}


def clear(spark: SparkSession, path: str) -> None:
    """Deletes all tables, whatever the file system."""
    at, fs = _fs(spark, path)
    fs.delete(at, True)
