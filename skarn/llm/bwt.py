"""Long common substrings of a block of byte strings, by threshold-bounded interval expansion on its BWT."""

from __future__ import annotations

import numpy as np


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorting permutation of keys, and the dense rank of each key."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    step = np.empty(len(s), np.int64)
    step[:1] = 0
    step[1:] = s[1:] != s[:-1]
    rank = np.empty(len(s), np.int64)
    rank[order] = np.cumsum(step)
    return order, rank


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of symbols (0..511) in the order of at least their first depth symbols, by prefix doubling."""
    n = len(symbols)
    wide = np.zeros(n + 7, np.int64)
    wide[:n] = symbols
    key = np.zeros(n, np.int64)
    for j in range(7):
        key = (key << 9) | wide[j : n + j]
    order, rank = _ranks(key)
    have = 7
    while have < depth and rank[order[-1]] + 1 < n:
        after = np.zeros(n, np.int64)
        after[: max(0, n - have)] = rank[have:] + 1
        order, rank = _ranks(rank * (n + 1) + after)
        have *= 2
    return order


def intervals(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Interval number of every place of the suffix order: suffixes with a common prefix of length symbols share one.

    Breadth-first backward extension: the intervals of all strings of l symbols, from l = 0, are extended to
    the left by every symbol c at once.  The interval of c + w begins C[c] + occ(c, begin of w) places in, so
    in the order of (BWT symbol, place) - the F column - it begins wherever the symbol or the interval of w
    changes.  A boundary that first shows for strings of l + 1 symbols has a longest common prefix of l; the
    expansion stops at length, and places without a boundary by then share at least that many symbols.
    """
    n = len(symbols)
    bwt = symbols[order - 1]  # the symbol before each suffix; the first suffix wraps round to the last symbol
    back = np.argsort(bwt, kind="stable").astype(np.int64)
    first = np.empty(n, bool)
    first[0] = True
    c = bwt[back]
    first[1:] = c[1:] != c[:-1]
    group = np.zeros(n, np.int32)
    begins = np.empty(n, bool)
    begins[0] = True
    for _ in range(length):
        g = group[back]
        np.not_equal(g[1:], g[:-1], out=begins[1:])
        np.logical_or(begins, first, out=begins)
        np.cumsum(begins, out=group, dtype=np.int32)
    return group - 1


def covered_windows(data: np.ndarray, offsets: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of each length-byte window that also starts in a string of a smaller owner.

    data[offsets[i]:offsets[i + 1]] is string i; windows lie within one string.
    """
    m = len(offsets) - 1
    sizes = np.diff(offsets)
    # every string is followed by a separator, 0; bytes are shifted by one
    symbols = np.zeros(len(data) + m, np.int64)
    of = np.repeat(np.arange(m), sizes)
    symbols[np.arange(len(data)) + of] = data.astype(np.int64) + 1
    start = offsets[:-1] + np.arange(m)
    order = suffix_order(symbols, length + 1)
    group = intervals(symbols, order, length)
    string = np.repeat(np.arange(m), sizes + 1)
    at = np.arange(len(symbols)) - start[string]
    whole = at + length <= sizes[string]
    rank = np.where(whole, owner[string], np.iinfo(np.int64).max)[order]
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    least = np.minimum.reduceat(rank, begin)[group]
    hit = order[(least < rank) & whole[order]]
    hit.sort()
    return string[hit], at[hit]
