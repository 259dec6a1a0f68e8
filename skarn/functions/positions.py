"""Positions in texts: (line, character) to offset and back, as Column expressions.

Lines are split on \\n, lines and characters count from 0, and offsets count characters of the column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def position_to_offset(text: Column, line: Column, char: Column) -> Column:
    """Offset of a position, or -1 beyond the last line or the end of the line."""
    lines = F.split(text, "\n")
    before = F.aggregate(F.slice(lines, F.lit(1), F.greatest(line, F.lit(0))), F.lit(0), lambda a, s: a + F.length(s) + 1)
    inside = (line >= 0) & (line < F.size(lines)) & (char >= 0) & (char <= F.length(F.get(lines, line)))
    return F.when(inside, before + char).otherwise(F.lit(-1))


def line_of(text: Column, offset: Column) -> Column:
    """0-based line of an offset; an offset past the end is on the last line."""
    head = F.substring(text, F.lit(1), F.least(offset, F.length(text)))
    return F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))


def char_of(text: Column, offset: Column) -> Column:
    """0-based character in the line of an offset; an offset past the end is at the end of the last line."""
    head = F.substring(text, F.lit(1), F.least(offset, F.length(text)))
    return F.length(F.substring_index(head, "\n", -1))
