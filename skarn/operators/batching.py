"""Package-aware batches of files, and their maintenance."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.operators.lineage import cut

#: First batches aim at TARGET files and split packages over LARGEST; SMALLEST may not be flushed.
TARGET, LARGEST, SMALLEST = 150, 300, 50
#: A maintained batch takes files below ROOM, and merges with another while both hold at most that.
ROOM, MERGE_BELOW, REBATCH_AFTER = 250, 100, 20


def pack(sizes: Iterable[tuple[str, int]]) -> list[list[tuple[str, int, int]]]:
    """Batches of (package, first file, files) from packages with their file counts, in order."""
    out: list[list[tuple[str, int, int]]] = []
    open_: list[tuple[str, int, int]] = []
    held = 0

    def flush() -> None:
        nonlocal open_, held
        if open_:
            out.append(open_)
        open_, held = [], 0

    for package, n in sizes:
        if n > LARGEST:
            flush()
            out.extend([(package, at, min(LARGEST, n - at))] for at in range(0, n, LARGEST))
            continue
        if held + n > TARGET and held >= SMALLEST:
            flush()
        if n:
            open_.append((package, 0, n))
            held += n
    flush()
    return out


def plan_batches(files: DataFrame, group: list[str], package: str = "package", order: str = "pos") -> DataFrame:
    """(group..., package, first, files, batch): the greedy plan, made per group from package counts alone.

    Packages come in the order of their first file.  Only one row per package reaches the sequential step.
    """
    counts = files.groupBy(*group, package).agg(F.count("*").alias("n"), F.min(order).alias("at"))
    types = dict(files.dtypes)
    ddl = ", ".join(f"{g} {types[g]}" for g in group) + f", {package} {types[package]}, first long, files long, batch long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", package])
        key = [pdf[g].iloc[0] for g in group]
        rows = [(*key, p, first, n, b) for b, batch in enumerate(pack(zip(pdf[package], pdf["n"]))) for p, first, n in batch]
        return pd.DataFrame(rows, columns=[*group, package, "first", "files", "batch"])

    return counts.groupBy(*group).applyInPandas(run, ddl)


def chunks(files: DataFrame, order: list[str], size: int = 100) -> DataFrame:
    """Files with their fixed-size chunk in the given order.

    Ranks come from range partitions: each is counted, and rows are numbered within it only.
    """
    spread = cut(files.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).drop("_n")  # a row per partition
    w = Window.partitionBy("_part").orderBy(*order)
    ranked = spread.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.row_number().over(w) - 1)
    return ranked.withColumn("chunk", F.floor(F.col("_rank") / size)).drop("_part", "_before", "_rank")


def _before(rows: DataFrame, group: list[str], order: str, weight: str | None = None, buckets: int = 64) -> DataFrame:
    """Rows with _before: the weights (or number) of the rows before them in their group, in an order of hash buckets.

    Sums of buckets come first, so that no group is ordered in one task.
    """
    w = F.col(weight) if weight else F.lit(1)
    dealt = rows.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)))
    sums = dealt.groupBy(*group, "_b").agg(F.sum(w).alias("_w"))
    sums = sums.withColumn("_first", F.sum("_w").over(Window.partitionBy(*group).orderBy("_b")) - F.col("_w")).drop("_w")  # as many rows a group as buckets
    inside = Window.partitionBy(*group, "_b").orderBy(order)
    both = dealt.join(sums, [*group, "_b"])
    return both.withColumn("_before", F.col("_first") + F.sum(w).over(inside) - w).drop("_b", "_first")


def _sized(batches: DataFrame) -> DataFrame:
    """(batch_id, package, n): a batch belongs to the package of its first file; no package is the default one."""
    return batches.groupBy("batch_id").agg(F.coalesce(F.min_by("package", "file_id"), F.lit("")).alias("package"), F.count("*").alias("n"))


def _dealt(batches: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New files with their place among those of their package, and with the batch that has room for it, or null.

    Free room is counted out: the k-th file of a package takes the k-th free place of its batches, so no batch
    is filled beyond ROOM.  Files and places meet in an equi-join.
    """
    files = _before(new.select("file_id", "package", F.coalesce("package", F.lit("")).alias("_package")), ["_package"], "file_id")
    room = _sized(batches).where(F.col("n") < ROOM).select("batch_id", F.col("package").alias("_package"), (F.lit(ROOM) - F.col("n")).alias("free"))
    wanted = files.groupBy("_package").agg(F.count("*").alias("_wanted"))
    at = _by_id(room).join(wanted, "_package").where("_before < _wanted")
    places = at.select("_package", "batch_id", F.explode(F.sequence(F.col("_before"), F.least(F.col("_before") + F.col("free"), F.col("_wanted")) - 1)).alias("_before"))
    return files.join(places, ["_package", "_before"], "left"), at


def _by_id(room: DataFrame) -> DataFrame:
    """Batches with the free room before them in their package, by id: range buckets keep the order that hash buckets would not."""
    spread = room.withColumn("_range", F.floor(F.col("batch_id") / 4096))
    sums = spread.groupBy("_package", "_range").agg(F.sum("free").alias("_sum"))
    sums = sums.withColumn("_first", F.sum("_sum").over(Window.partitionBy("_package").orderBy("_range")) - F.col("_sum")).drop("_sum")
    w = Window.partitionBy("_package", "_range").orderBy("batch_id")
    return spread.join(sums, ["_package", "_range"]).withColumn("_before", F.col("_first") + F.sum("free").over(w) - F.col("free")).drop("_range", "_first")


def attach_new(batches: DataFrame, new: DataFrame) -> DataFrame:
    """New files (file_id, package) with the batch each joins: one of its package with room, the smallest id first, else null.

    batches: (batch_id, file_id, package).
    """
    return _dealt(batches, new)[0].select("file_id", "package", "batch_id")


def attach(batches: DataFrame, new: DataFrame) -> DataFrame:
    """The batches with all new files: those that find no room open batches of at most ROOM files, with ids above all others."""
    placed = _dealt(batches, new)[0]
    held, rest = placed.where("batch_id IS NOT NULL"), placed.where("batch_id IS NULL").drop("batch_id", "_before")
    counted = cut(_before(rest, ["_package"], "file_id"))
    opened = counted.groupBy("_package").agg(F.ceil(F.count("*") / ROOM).alias("_batches"))
    top = batches.agg(F.max("batch_id")).first()[0]
    first = _before(opened.withColumn("_all", F.lit(0)), ["_all"], "_package", "_batches").select("_package", (F.lit(0 if top is None else top + 1) + F.col("_before")).alias("_at"))
    kind = batches.schema["batch_id"].dataType
    fresh = counted.join(first, "_package").select((F.col("_at") + F.floor(F.col("_before") / ROOM)).cast(kind).alias("batch_id"), "file_id", "package")
    columns = ["batch_id", "file_id", "package"]
    return batches.select(columns).unionByName(held.select(columns)).unionByName(fresh)


def state(batches: DataFrame) -> DataFrame:
    """Per batch: files, whether it must be split, whether it is small enough to merge."""
    n = batches.groupBy("batch_id").agg(F.count("*").alias("files"), F.min("package").alias("package"))
    return n.withColumn("needs_split", F.col("files") > ROOM).withColumn("may_merge", F.col("files") < MERGE_BELOW)


def split(batches: DataFrame) -> DataFrame:
    """(batch_id, file_id, package) with every batch that must be split planned anew; its parts get ids above all others."""
    flagged = state(batches).where("needs_split").select("batch_id")
    files = batches.join(flagged, "batch_id", "left_semi")
    plan = plan_batches(files, ["batch_id"], order="file_id")
    number = F.row_number().over(Window.orderBy("batch_id", "batch"))  # a row per new batch
    ids = plan.select("batch_id", "batch").distinct().withColumn("_new", number)
    last = batches.agg(F.max("batch_id").alias("_last"))
    parts = plan.join(ids, ["batch_id", "batch"]).crossJoin(F.broadcast(last)).withColumn("_new", (F.col("_last") + F.col("_new")).cast(batches.schema["batch_id"].dataType))
    at = F.row_number().over(Window.partitionBy("batch_id", "package").orderBy("file_id")) - 1
    parts = parts.select("batch_id", "package", "first", "files", "_new").alias("p")
    placed = files.withColumn("_at", at).alias("f")
    fits = (F.col("f.batch_id") == F.col("p.batch_id")) & F.col("f.package").eqNullSafe(F.col("p.package")) & (F.col("_at") >= F.col("p.first")) & (F.col("_at") < F.col("p.first") + F.col("p.files"))
    moved = placed.join(parts, fits).select(F.col("_new").alias("batch_id"), "f.file_id", "f.package")
    return batches.join(flagged, "batch_id", "left_anti").select("batch_id", "file_id", "package").unionByName(moved)


def merge_targets(batches: DataFrame) -> DataFrame:
    """(batch_id, into): where every small batch goes that another of its package can take; no batch is both.

    Small batches of a package are laid end to end and those that begin in one stretch of ROOM - MERGE_BELOW files
    become one, which holds ROOM at most.  That is repeated, at most logarithmically often, until a package has one small
    batch; this goes to the first other that has room.
    """
    sized = cut(_sized(batches))
    moved = sized.select("batch_id", F.col("batch_id").alias("into"))
    while True:
        small = _before(sized.where(F.col("n") < MERGE_BELOW), ["package"], "batch_id", "n").withColumn("_stretch", F.floor(F.col("_before") / (ROOM - MERGE_BELOW)))
        joined = cut(small.withColumn("_into", F.min("batch_id").over(Window.partitionBy("package", "_stretch"))).select("batch_id", "_into"))  # a few batches a stretch
        if joined.where("batch_id <> _into").isEmpty():
            break
        sized, moved = _moved(sized, moved, joined)
    last = sized.where(F.col("n") < MERGE_BELOW).select("package", "batch_id", F.col("n").alias("_n"))
    others = sized.select("package", F.col("batch_id").alias("_into"), F.col("n").alias("_there"))
    fits = last.join(others, "package").where((F.col("_into") != F.col("batch_id")) & (F.col("_n") + F.col("_there") <= ROOM))  # one small batch a package
    _, moved = _moved(sized, moved, cut(fits.groupBy("batch_id").agg(F.min("_into").alias("_into"))))
    return moved.where("batch_id <> into")


def _moved(sized: DataFrame, moved: DataFrame, joined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes and places after batches have joined (batch_id, _into)."""
    after = sized.join(joined, "batch_id", "left").withColumn("batch_id", F.coalesce("_into", "batch_id"))
    after = cut(after.groupBy("batch_id", "package").agg(F.sum("n").alias("n")))
    to = joined.select(F.col("batch_id").alias("into"), "_into")
    return after, cut(moved.join(to, "into", "left").select("batch_id", F.coalesce("_into", "into").alias("into")))


def merged(batches: DataFrame) -> DataFrame:
    """The batches after merge_targets: every file once, no batch above ROOM that was not before."""
    to = merge_targets(batches)
    out = batches.join(to, "batch_id", "left")
    return out.select(F.coalesce("into", "batch_id").alias("batch_id"), "file_id", "package")


def without_files(batches: DataFrame, gone: DataFrame) -> DataFrame:
    """The batches without files(file_id) that are gone; what became small is merged, and empty batches are no more."""
    return merged(batches.join(gone.select("file_id").distinct(), "file_id", "left_anti").select("batch_id", "file_id", "package"))
