"""Diagnostics: severities, ranges, protocol form, publication and JSON."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Compiler kinds and severities; other kinds are errors.
SEVERITY = {"ERROR": 1, "WARNING": 2, "MANDATORY_WARNING": 2, "NOTE": 3}
SCHEMA = "severity int, message string, filePath string, lineNumber int, columnNumber int, startPosition int, endPosition int, code string"


def severity(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    return F.coalesce(table[kind], F.lit(1))


def mapped(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """rows(code, kind, ...) with problem ids from codes(code, ids array): unknown errors get id 0, other unknowns go.

    A code may give several ids; -1 drops the row.
    """
    j = rows.join(codes, "code", "left").withColumn("ids", F.when(F.col("ids").isNull() & (F.col("kind") == "ERROR") & F.col("code").startswith("compiler.err"), F.array(F.lit(0))).otherwise(F.col("ids")))
    return j.withColumn("problem_id", F.explode("ids")).where("problem_id <> -1").drop("ids")


def filtered(rows: DataFrame, serial_version: int) -> DataFrame:
    """rows(problem_id, severity, interfaces, start, ...) that are reported.

    Ignored and optional severities go, missing serial versions (their problem id is given) of classes with
    Externalizable among their interfaces, and rows without a position.
    """
    ignored = F.coalesce(F.col("severity").isin("Ignore", "Optional"), F.lit(False))
    external = F.coalesce((F.col("problem_id") == serial_version) & F.array_contains("interfaces", "java.io.Externalizable"), F.lit(False))
    return rows.where(~ignored & ~external & F.col("start").isNotNull())


def inclusive_range(offset: Column, length: Column, text_length: Column) -> tuple[Column, Column]:
    """(start, end inclusive); an empty range at the end of the text moves one to the left."""
    start = F.when((length <= 0) & (offset >= text_length) & (offset > 0), offset - 1).otherwise(offset)
    return start, start + F.greatest(length - 1, F.lit(0))


def protocol(rows: DataFrame) -> DataFrame:
    """0-based lines, one-character ranges; unknown severities are information."""
    line = F.greatest(F.col("line") - 1, F.lit(0))
    return rows.select("file_path", F.struct(line.alias("line"), F.col("col").alias("character")).alias("start"), F.struct(line.alias("line"), (F.col("col") + 1).alias("character")).alias("end"), F.when(F.col("severity").isin(1, 2, 3), F.col("severity")).otherwise(F.lit(3)).alias("severity"), "message", F.lit("java").alias("source"))


def publish(rows: DataFrame) -> DataFrame:
    """One row per file with its diagnostics in order of position."""
    item = F.struct("line", "col", "severity", "message")
    return rows.groupBy("file_path").agg(F.sort_array(F.collect_list(item)).alias("diagnostics"))


def to_json(rows: DataFrame) -> DataFrame:
    x = F.struct("severity", "message", F.col("file_path").alias("filePath"), F.col("line").alias("lineNumber"), F.col("col").alias("columnNumber"), F.col("start").alias("startPosition"), F.col("end").alias("endPosition"), "code")
    return rows.select("file_path", F.to_json(x).alias("json"))


def from_json(rows: DataFrame) -> DataFrame:
    """Rows that parse; malformed ones are skipped."""
    x = F.from_json("json", SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return rows.select(x.alias("x")).where("x is not null and x._bad is null").select("x.*").drop("_bad")


def of_project(rows: DataFrame, project_path: str) -> DataFrame:
    return rows.where(F.col("file_path").startswith(project_path.rstrip("/") + "/"))


def store(rows: DataFrame, fresh: DataFrame, files: DataFrame) -> DataFrame:
    """Rows with those of files(path) replaced by fresh ones; a file without fresh rows has none any more."""
    return rows.join(files.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti").unionByName(fresh)


def files_with_diagnostics(rows: DataFrame) -> DataFrame:
    """(path) of the files that have any."""
    return rows.select(F.col("file_path").alias("path")).distinct()


def of_file(rows: DataFrame, path: str) -> DataFrame:
    return rows.where(F.col("file_path") == path)


def send(published: DataFrame, clients: Iterable[Callable[[str, list], None]]) -> int:
    """Pushes each file's diagnostics to every client; a client that fails does not stop the others. Returns failures.

    Files come to the driver one partition at a time.
    """
    clients, failed = list(clients), 0
    for row in published.toLocalIterator():
        for c in clients:
            try:
                c(row.file_path, row.diagnostics)
            except Exception:
                failed += 1
                logging.getLogger(__name__).exception("a client did not take diagnostics of %s", row.file_path)
    return failed
