"""Classpath entries of projects, from an Eclipse file, from a build tool's output, or from a cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Entry kinds and what they become; other kinds are ignored.
KINDS = {"src": "SOURCE", "lib": "LIBRARY", "output": "SOURCE"}
#: Source folders that a Maven project has by convention, relative to it.
CONVENTIONAL = ("src/main/java", "src/test/java", "src/main/resources", "src/test/resources")
#: Discoverers by priority; the largest that accepts a project wins.
PRIORITY = {"maven": 100, "eclipse": 1}
ENTRIES = "project string, type string, path string, ordinal int"


def eclipse(files: DataFrame) -> DataFrame:
    """ENTRIES of classpath files(project, project_path, content); a file cut short gives what can be read.

    Content comes as a column because Spark's readers pass over files whose name starts with a dot.
    """
    entry = F.posexplode(F.regexp_extract_all("content", F.lit("<classpathentry\\b[^>]*>"), F.lit(0)))
    value = lambda name: F.regexp_extract("entry", rf"\b{name}\s*=\s*[\"']([^\"']*)", 1)
    kinds = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    rows = files.select("project", "project_path", entry.alias("_o", "entry")).select("project", "project_path", "_o", kinds[value("kind")].alias("type"), value("path").alias("_path")).where("type is not null")
    path = F.when(F.col("_path").startswith("/"), F.col("_path")).otherwise(F.concat_ws("/", F.rtrim("project_path", F.lit("/")), "_path"))
    ordinal = F.row_number().over(Window.partitionBy("project").orderBy("_o")) - 1
    return rows.select("project", "type", path.alias("path"), ordinal.alias("ordinal"))


def read_hidden(spark: SparkSession, project: str, project_path: str, name: str = ".classpath") -> DataFrame:
    """(project, project_path, content) of one small file of a project, on any file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(project_path, name)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return spark.createDataFrame([], "project string, project_path string, content string")
    with_stream = fs.open(at)
    try:
        content = jvm.org.apache.commons.io.IOUtils.toString(with_stream, "UTF-8")
    finally:
        with_stream.close()
    return spark.createDataFrame([(project, project_path, content)], "project string, project_path string, content string")


def build_output(lines: DataFrame, separator: str = ":") -> DataFrame:
    """ENTRIES from a build tool's output lines(project, line): jars in order, each path once.

    Lines without a jar or a separator are messages and are skipped.
    """
    useful = lines.where(F.col("line").contains(".jar") | F.col("line").contains(separator)).where(~F.col("line").startswith("["))
    joined = useful.groupBy("project").agg(F.array_join(F.collect_list("line"), separator).alias("all"))
    parts = F.array_distinct(F.filter(F.transform(F.split("all", F.lit(separator)), lambda p: F.trim(p)), lambda p: p != ""))
    return joined.select("project", F.lit("LIBRARY").alias("type"), F.posexplode(parts).alias("ordinal", "path")).select("project", "type", "path", "ordinal")


def existing(entries: DataFrame, present: DataFrame) -> DataFrame:
    """Entries whose path is among present(path)."""
    return entries.join(present.select("path").distinct(), "path", "left_semi").select("project", "type", "path", "ordinal")


def discover(accepted: DataFrame) -> DataFrame:
    """(project, discoverer) that wins, from accepted(project, discoverer)."""
    rank = F.create_map(*(F.lit(x) for kv in PRIORITY.items() for x in kv))
    return accepted.groupBy("project").agg(F.max_by("discoverer", F.coalesce(rank[F.col("discoverer")], F.lit(0))).alias("discoverer"))


def valid_caches(caches: DataFrame, sources: DataFrame) -> DataFrame:
    """caches(project, mtime_ms) no source (project, mtime_ms) is strictly newer than."""
    newest = sources.groupBy("project").agg(F.max("mtime_ms").alias("_newest"))
    return caches.join(newest, "project", "left").where("_newest is null or _newest <= mtime_ms").drop("_newest")


def cache_path(folder: str, project: str) -> str:
    """Where a project's classpath is cached: its name, with odd characters as _."""
    import re

    return f"{folder.rstrip('/')}/{re.sub('[^a-zA-Z0-9._-]', '_', project)}"


def write_cache(entries: DataFrame, folder: str, project: str) -> None:
    entries.where(F.col("project") == project).coalesce(1).write.mode("overwrite").json(cache_path(folder, project))  # one project's entries


def read_cache(spark: SparkSession, folder: str, project: str) -> DataFrame:
    """The cached entries, stale or not; none where there is no cache."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(ENTRIES).json(cache_path(folder, project))
    except AnalysisException:
        return spark.createDataFrame([], ENTRIES)


def conventional(projects: DataFrame, present: DataFrame) -> DataFrame:
    """ENTRIES of the conventional source folders of projects(project, project_path) that are present(path)."""
    folders = F.posexplode(F.array(*(F.lit(c) for c in CONVENTIONAL))).alias("ordinal", "_f")
    rows = projects.select("project", "project_path", folders).select("project", F.lit("SOURCE").alias("type"), F.concat_ws("/", F.rtrim("project_path", F.lit("/")), "_f").alias("path"), "ordinal")
    return existing(rows, present)
