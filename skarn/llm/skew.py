"""Joins on keys of which one may hold a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = 1000
SALTS = 64


def heavy(rows: DataFrame, key: list[str], total: int, least: int = 5000) -> DataFrame:
    """Keys with more than a SHARE-th of ``total`` rows (and ``least``): at most SHARE of them, so fit to be broadcast."""
    return rows.groupBy(*key).agg(F.count("*").alias("_times")).where(F.col("_times") > max(least, total // SHARE)).select(*key)


def salted_join(many: DataFrame, one: DataFrame, key: list[str], total: int, how: str = "inner", least: int = 5000, hot: DataFrame | None = None) -> DataFrame:
    """``many`` joined with ``one``, which has few rows a key; heavy keys of ``many`` are dealt over SALTS partitions.

    ``hot`` names those keys, at most SHARE, where they are known; else they are counted.
    """
    hot = F.broadcast((heavy(many, key, total, least) if hot is None else hot.select(*key)).withColumn("_hot", F.lit(True)))
    salted = many.join(hot, key, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*(c for c in many.columns)), F.lit(SALTS)).cast("int")).otherwise(0)).drop("_hot")
    spread = one.join(hot, key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(spread, [*key, "_salt"], how).drop("_salt")
