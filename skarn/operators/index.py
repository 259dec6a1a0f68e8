"""The symbol index: typed tables derived from extracted facts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.operators.javaparse import extract
from skarn.operators.lineage import cut
from skarn.operators.maintain import intern, last_writer
from skarn.operators.projects import of_project

TABLES = ("types", "methods", "fields", "type_refs", "name_refs", "diagnostics")


def _loc():
    return F.struct("file_id", "start", "end", "line", "col").alias("loc")


def tables(facts: DataFrame, registry: DataFrame) -> dict[str, DataFrame]:
    """TABLES and `files` from FACTS and a registry(file_id, path), by one equi-join."""
    f = facts.join(registry, "path")
    of = lambda rel: f.where(F.col("rel") == rel)
    items = F.coalesce("items", F.array().cast("array<string>"))
    key = F.concat("owner", F.lit("."), "name")
    return {
        "types": of("types").select(F.col("name").alias("qualified_name"), F.col("owner").alias("simple_name"), "package_name", "kind", "modifiers", "superclass", items.alias("interfaces"), _loc()),
        "methods": of("methods").select(F.col("owner").alias("declaring_type"), F.col("name").alias("method_name"), items.alias("param_types"), F.col("type").alias("return_type"), "modifiers", "is_constructor", F.concat(key, F.lit("("), F.array_join(items, ","), F.lit(")")).alias("signature_key"), _loc()),
        "fields": of("fields").select(F.col("owner").alias("declaring_type"), F.col("name").alias("field_name"), F.col("type").alias("field_type"), "modifiers", key.alias("field_key"), _loc()),
        "type_refs": of("type_refs").select(F.col("name").alias("target"), "kind", _loc()),
        "name_refs": of("name_refs").select("name", "kind", _loc()),
        "diagnostics": of("diagnostics").select(F.col("path").alias("file_path"), F.lit(1).alias("severity"), "message", "line", F.lit(0).alias("col"), "start", (F.col("end") - 1).alias("end"), F.lit(None).cast("string").alias("code")),
        "files": registry,
    }


def build(files: DataFrame) -> dict[str, DataFrame]:
    """The index of files(path, mtime_ms, content); one file's facts are parsed once and kept."""
    registry = cut(intern(files).join(files.select("path", "mtime_ms"), "path").select("file_id", "path", "mtime_ms"))
    facts = cut(extract(files))
    out = tables(facts, registry.select("file_id", "path"))
    out["files"] = registry
    return out


def build_in_phases(files: DataFrame, classpath: list[str], ready: Callable[[dict[str, DataFrame]], None]) -> dict[str, DataFrame]:
    """Declarations first, in a job of their own that reads no bodies; ``ready`` gets them before any body is read.

    Then references, and diagnostics with them, which an empty classpath leaves out.
    """
    registry = cut(intern(files).join(files.select("path", "mtime_ms"), "path").select("file_id", "path", "mtime_ms"))
    ids = registry.select("file_id", "path")
    early = tables(cut(extract(files, bodies=False)), ids) | {"files": registry}
    ready(early)
    whole = tables(cut(extract(files, diagnose=bool(classpath))), ids)
    return whole | {"files": registry}


def distinct_declarations(index: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Declarations with one row per key: where several files declare it, the last file wins."""
    keys = {"types": "qualified_name", "methods": "signature_key", "fields": "field_key"}
    return index | {t: last_writer(index[t], [k], ["loc"]) for t, k in keys.items()}


def stats(index: dict[str, DataFrame]) -> DataFrame:
    """One row of counts."""
    rows = None
    for t in ("types", "methods", "fields", "files"):
        one = index[t].agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n")
        rows = one if rows is None else rows.union(one)
    return rows.groupBy().pivot("table", ["types", "methods", "fields", "files"]).sum("n")


def remove_files(index: dict[str, DataFrame], gone: DataFrame, compat: bool = False) -> dict[str, DataFrame]:
    """The index without the facts of files(file_id, path) that are gone.

    compat: the types that these files declare go altogether, with what other files declare of or in them.
    """
    ids = gone.select("file_id").distinct()
    if compat:
        names = index["types"].join(ids, F.col("loc.file_id") == ids["file_id"], "left_semi").select(F.col("qualified_name").alias("declaring_type")).distinct()
        others = {t: index[t].join(names, "declaring_type", "left_anti").select(*index[t].columns) for t in ("methods", "fields")}
        others["types"] = index["types"].join(names, F.col("qualified_name") == F.col("declaring_type"), "left_anti")
        return remove_files(index | others, gone)
    out = {t: index[t].join(ids, F.col("loc.file_id") == ids["file_id"], "left_anti") for t in ("types", "methods", "fields", "type_refs", "name_refs")}
    out["diagnostics"] = index["diagnostics"].join(gone.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti")
    out["files"] = index["files"].join(ids, "file_id", "left_anti")
    return index | out


def reindex(index: dict[str, DataFrame], changed: DataFrame) -> dict[str, DataFrame]:
    """Changed files(path, mtime_ms, content) replace their facts; known paths keep their ids."""
    registry = cut(intern(changed, index["files"].select("file_id", "path")))
    mine = registry.join(changed.select("path", "mtime_ms"), "path")
    rest = remove_files(index, mine)
    fresh = tables(cut(extract(changed)), mine.select("file_id", "path"))
    out = {t: rest[t].unionByName(fresh[t]) for t in TABLES}
    out["files"] = rest["files"].unionByName(mine.select("file_id", "path", "mtime_ms"))
    return out


# lookups
def lookup(table: DataFrame, key: str, value: object) -> DataFrame:
    """Rows by exact key; the filter reaches a stored table's scan."""
    return table.where(F.col(key) == value)


def members(table: DataFrame, types: DataFrame) -> DataFrame:
    """Rows of methods or fields whose type is among types(declaring_type)."""
    return table.join(types.select("declaring_type").distinct(), "declaring_type", "left_semi")


def with_path(refs: DataFrame, files: DataFrame) -> DataFrame:
    """Locations regain their path."""
    return refs.join(files.select(F.col("file_id").alias("_id"), "path"), F.col("loc.file_id") == F.col("_id")).drop("_id")


def resolved_refs(index: dict[str, DataFrame]) -> DataFrame:
    """Type references with same-package simple names qualified, by a join on package and simple name."""
    t = index["types"]
    package = t.select(F.col("loc.file_id").alias("_f"), F.col("package_name").alias("_p")).distinct()
    known = t.select(F.col("package_name").alias("_p"), F.col("simple_name").alias("_s"), F.col("qualified_name").alias("_q")).distinct()
    r = index["type_refs"].join(package, F.col("loc.file_id") == F.col("_f"), "left")
    r = r.join(known, (r["_p"] == known["_p"]) & (r["target"] == known["_s"]), "left")
    return r.select(F.coalesce("_q", "target").alias("target"), "kind", "loc")


def remove_project(index: dict[str, DataFrame], project_path: str) -> dict[str, DataFrame]:
    """The index without the files below a project's path."""
    project = index["files"].sparkSession.createDataFrame([("project", project_path)], "name string, path string")
    return remove_files(index, of_project(index["files"], project, "project"))


def parse_quality(index: dict[str, DataFrame]) -> DataFrame:
    """One row: files, files with errors, errors, and the share of files with errors in percent."""
    bad = index["diagnostics"].agg(F.count("*").alias("errors"), F.countDistinct("file_path").alias("files_with_errors"))
    n = index["files"].agg(F.count("*").alias("files"))
    both = n.withColumn("_k", F.lit(1)).join(F.broadcast(bad.withColumn("_k", F.lit(1))), "_k").drop("_k")  # one row each
    return both.withColumn("percent", F.round(100.0 * F.col("files_with_errors") / F.greatest("files", F.lit(1)), 4))


def node_quality(nodes: DataFrame) -> DataFrame:
    """One row: nodes, erroneous ones, kinds of errors, and the share of erroneous nodes in percent."""
    bad = F.col("kind") == "diagnostics"
    n = nodes.agg(F.count("*").alias("nodes"), F.count(F.when(bad, 1)).alias("erroneous"), F.countDistinct(F.when(bad, F.col("name"))).alias("error_types"))
    return n.withColumn("percent", F.round(100.0 * F.col("erroneous") / F.greatest("nodes", F.lit(1)), 4))


def file_metadata(index: dict[str, DataFrame], paths: DataFrame) -> DataFrame:
    """(path, indexed, types, mtime_ms) of paths(path): the declared types, null for files that are not indexed, and their stamp or 0."""
    asked = paths.select("path").distinct()
    known = index["files"].join(asked, "path").select("path", "file_id", "mtime_ms")
    declared = index["types"].select(F.col("loc.file_id").alias("file_id"), "qualified_name").join(known.select("file_id"), "file_id", "left_semi")
    declared = declared.groupBy("file_id").agg(F.sort_array(F.collect_set("qualified_name")).alias("types"))
    both = asked.join(known.join(declared, "file_id", "left"), "path", "left")
    types = F.when(F.col("file_id").isNotNull(), F.coalesce("types", F.array().cast("array<string>")))
    return both.select("path", F.col("file_id").isNotNull().alias("indexed"), types.alias("types"), F.coalesce("mtime_ms", F.lit(0).cast("long")).alias("mtime_ms"))
