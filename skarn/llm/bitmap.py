"""Bitmaps of fixed size, to leave most rows out of a shuffle before an exact join decides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of a bitmap; those of excluded() grow to MOST where there are more hashes.
BITS = 1 << 22
MOST = 1 << 26


def _slot(h: Column, bits: int | None = None) -> tuple[Column, Column]:
    b = h.bitwiseAND(F.lit((bits or BITS) - 1))
    return F.shiftright(b, 6), F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)).cast("int"))


def bitmap(hashes: DataFrame, name: str, size: int | None = None) -> DataFrame:
    """A bitmap of BITS bits (or ``size``), as at most BITS / 64 rows, of the hashes in column h."""
    word, bit = _slot(F.col("h"), size)
    return hashes.select(word.alias(f"{name}_word"), bit.alias("bit")).groupBy(f"{name}_word").agg(F.bit_or("bit").alias(name))


def may_be_in(rows: DataFrame, bits: DataFrame, name: str, h: Column, how: str = "inner", size: int | None = None) -> tuple[DataFrame, Column]:
    """Rows joined with the bitmap (broadcast: of fixed size), and whether the hash may be in it."""
    word, bit = _slot(h, size)
    joined = rows.join(F.broadcast(bits), word == F.col(f"{name}_word"), how)
    return joined.drop(f"{name}_word"), F.coalesce(F.col(name).bitwiseAND(bit) != 0, F.lit(False))


def _at(level: int, key: str) -> Column:
    return F.xxhash64(key, F.lit(level))


def cascade(every: DataFrame, gone: DataFrame, key: str, keep: Callable[[DataFrame, str], DataFrame]) -> tuple[list[DataFrame], int]:
    """Four bitmaps and their size, for not_in(): of the keys that are gone, of others of ``every`` that hit these bits, of
    gone ones that hit those, and of others that hit these again.

    One bitmap alone would leave out keys that are not gone.  Each level has hashes of its own: with the same ones, every
    gone key that shares its bit with another key would be kept.  Two levels keep a share of the gone keys that grows with
    the input; after four hardly any is kept.  ``keep`` stores a frame under the name of a level.
    """
    size = BITS
    while size < min(MOST, 16 * gone.count()):
        size *= 2
    levels, hits, others = [], gone.select(key), None
    for k in range(4):
        levels.append(bitmap(hits.select(_at(k, key).alias("h")), f"level{k}", size))
        if k < 3:
            side = others if others is not None else every.select(key)
            some, maybe = may_be_in(side, levels[k], f"level{k}", _at(k, key), size=size)
            some = some.where(maybe).select(key)
            hits, others = keep(some.join(gone.select(key), key, "left_anti") if k == 0 else some, f"level{k + 1}"), hits
    return levels, size


def not_in(rows: DataFrame, levels: list[DataFrame], size: int, key: str) -> DataFrame:
    """All rows whose key is not gone; hardly any of those that are gone stay."""
    columns, hit = rows.columns, []
    for k, bits in enumerate(levels):
        rows, maybe = may_be_in(rows, bits, f"level{k}", _at(k, key), "left", size)
        rows = rows.withColumn(f"hit{k}", maybe).drop(f"level{k}")
        hit.append(F.col(f"hit{k}"))
    return rows.where(~hit[0] | (hit[1] & (~hit[2] | hit[3]))).select(*columns)
