"""Benchmark decontamination by spaced-seed hashing (operator 8).

Words are lower-cased (A-Z) and lose punctuation at their edges.  A mask is a pattern of cared-for and ignored
word positions; the words under its cared-for positions are hashed in the benchmark items and at every
position of every document.  Equal hashes are hits, and each hit's alignment is verified on the words
themselves: the overlap must hold a window of ``window`` words (the whole item, if shorter) of which at least
``similarity`` are equal, so that substituted words are tolerated anywhere.

Masks follow from the length of the window: cut into m pieces, it keeps m - k of them whole under any k
substitutions, so the masks of all choices of m - k pieces miss nothing that the threshold accepts.  m is the
least number that leaves ``WEIGHT`` words under every mask, where one does within ``MOST`` masks.

The benchmark side travels to the executors in blocks of at most ``block_bytes`` of item text; its size is
counted first, and a larger benchmark takes several passes over the documents, one per block.  Documents are
read whole.

Null or empty texts match nothing; null or empty items are never matched; an empty benchmark leaves all
documents clean; repeated rows are judged alike.  An item has one hit in a document, over all texts that its id
has: the overlap with the most equal words, of these the earliest.  Input columns are returned unchanged, whatever their names.
"""

from __future__ import annotations

from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.session import cut
from skarn.llm.textops import Chunk, U64, chunks, mix, plain_hashes

#: Words that a mask should compare, and masks that a window may have for it.
WEIGHT, MOST = 4, 64
WINDOW = 20
SIMILARITY = 0.8
BLOCK_BYTES = 16 << 20
HITS = "array<struct<item_id: bigint, first_word: bigint, n_words: bigint, n_equal: bigint>>"
_HIT = pa.struct([("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("n_equal", pa.int64())])


def _need(n: int, similarity: float) -> int:
    """Equal words that a window of n words must hold."""
    return max(1, ceil(similarity * n - 1e-9))


def masks(n: int, similarity: float) -> list[tuple[int, str]]:
    """(offset, mask) of seeds in a window of n words; 1: the word counts, 0: it is ignored.

    Whatever words are substituted, as long as similarity * n are equal, one seed is untouched.
    """
    k = n - _need(n, similarity)
    if k < 0:
        return []
    ways = {m: sum(sorted((i + 1) * n // m - i * n // m for i in range(m))[: m - k]) for m in range(k + 1, n + 1) if m == k + 1 or comb(m, k) <= MOST}
    m = next((m for m, least in ways.items() if least >= WEIGHT), max(ways, key=lambda m: (ways[m], -m)))
    piece = [range(i * n // m, (i + 1) * n // m) for i in range(m)]
    out = set()
    for kept in combinations(piece, m - k):
        cared = {j for p in kept for j in p}
        out.add((min(cared), "".join("01"[j in cared] for j in range(min(cared), max(cared) + 1))))
    return sorted(out)


def _seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the words under the mask, at each position that it fits."""
    m = len(words) - len(mask) + 1
    if m <= 0:
        return np.zeros(0, U64)
    h = np.full(m, U64(len(mask)))
    for j, bit in enumerate(mask):
        if bit == "1":
            h = h * U64(0xF1357AEA2E62A9C5) + words[j : j + m]
    return mix(h)


def _words(text: str) -> np.ndarray:
    data = text.encode("utf-8", "replace")
    c = Chunk(0, np.frombuffer(data, np.uint8), np.array([0, len(data)]), lower=True)
    return plain_hashes(c, *c.words())


class Seeds:
    """Seed hashes of some benchmark items, sorted, and the items' words to verify against."""

    def __init__(self, items: list[tuple[int, str]], window: int, similarity: float):
        self.window, self.similarity = window, similarity
        self.ids = [i for i, _ in items]
        self.words = [_words(t) for _, t in items]
        own: dict[str, list[tuple[int, int | None]]] = {}  # by mask: item, and where in it (None: at all positions)
        of = {n: masks(n, similarity) for n in {min(window, len(w)) for w in self.words} if n > 0}
        for k, w in enumerate(self.words):
            for at, mask in of.get(min(window, len(w)), ()):
                own.setdefault(mask, []).append((k, at if len(w) <= window else None))
        self.masks = sorted(own)
        self.tables = []
        for mask in self.masks:
            h, item, pos = [], [], []
            for k, at in dict.fromkeys(own[mask]):
                x = _seeds(self.words[k], mask)
                p = np.arange(len(x)) if at is None else np.array([at])
                h.append(x[p])
                pos.append(p)
                item.append(np.full(len(p), k))
            h, item, pos = np.concatenate(h), np.concatenate(item), np.concatenate(pos)
            o = np.argsort(h, kind="stable")
            some = np.zeros(1 << 18, bool)  # most positions of a document end at this lookup
            some[(h & U64((1 << 18) - 1)).astype(np.int64)] = True
            self.tables.append((h[o], item[o], pos[o], some))

    def _candidates(self, words: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct (document, item, alignment) of the hits; alignment: document word at the item's first word."""
        found = []
        for mask, (h, item, pos, some) in zip(self.masks, self.tables):
            seeds = _seeds(words, mask)
            if not len(h) or not len(seeds):
                continue
            at = np.flatnonzero(some[(seeds & U64((1 << 18) - 1)).astype(np.int64)])
            at = at[doc[at] == doc[at + len(mask) - 1]]
            lo, hi = np.searchsorted(h, seeds[at], "left"), np.searchsorted(h, seeds[at], "right")
            n = hi - lo
            if n.sum():
                k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                j = np.repeat(at, n)
                found.append(np.column_stack([doc[j], item[k], j - pos[k]]))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)

    def verify(self, words: np.ndarray, first: int, last: int, item: int, diag: int) -> tuple[int, int, int] | None:
        """Longest verified run (first word in the document, words, equal words) on one alignment, or None."""
        b = self.words[item]
        lo, hi = max(0, first - diag), min(len(b), last - diag)
        w = min(self.window, len(b))
        if hi - lo < w:
            return None
        same = words[diag + lo : diag + hi] == b[lo:hi]
        c = np.concatenate([[0], np.cumsum(same)])
        good = np.flatnonzero(c[w:] - c[:-w] >= _need(w, self.similarity))
        if not len(good):
            return None
        s, e = good[0], good[-1] + w
        return diag + lo + int(s) - first, int(e - s), int(c[e] - c[s])

    def search(self, texts: pa.Array) -> list[list[dict]]:
        out: list[list[dict]] = []
        for c in chunks(texts, lower=True):
            start, end = c.words()
            doc = c.doc_of(start)
            words = plain_hashes(c, start, end)
            rows: list[list[dict]] = [[] for _ in range(c.n)]
            bound = np.searchsorted(doc, np.arange(c.n + 1))
            best: dict[tuple[int, int], tuple[int, int, int]] = {}  # by document and id: an id may have several texts
            for d, item, diag in self._candidates(words, doc).tolist():
                got = self.verify(words, int(bound[d]), int(bound[d + 1]), item, diag)
                key = d, self.ids[item]
                if got and (key not in best or (got[2], -got[0]) > (best[key][2], -best[key][0])):
                    best[key] = got
            for (d, item), (s, n, same) in sorted(best.items()):
                rows[d].append({"item_id": item, "first_word": s, "n_words": n, "n_equal": same})
            out += rows
        return out

    def column(self, text: Column) -> Column:
        me = self
        return F.arrow_udf(lambda texts: pa.array(me.search(texts), pa.list_(_HIT)), HITS)(text)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", window: int = WINDOW, similarity: float = SIMILARITY, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``row`` (the input row), ``hits`` (verified overlaps, one per item at most) and ``contaminated``."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).where("id is not null and text is not null").dropDuplicates()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-2 * int(size) // block_bytes))
    if blocks > 1:  # twice as many blocks as bytes need: hashing deals items unevenly
        items = cut(items.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks))))
    out = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs[text_col].cast("string").alias("text"), F.array().cast(HITS).alias("hits"))
    for k in range(blocks):
        part = items.where(F.col("block") == k) if blocks > 1 else items
        seeds = Seeds([(r["id"], r["text"]) for r in part.orderBy("id", "text").collect()], window, similarity)  # at most a block
        out = out.withColumn("hits", F.concat("hits", seeds.column(F.col("text"))))
        if blocks > 1:
            out = cut(out)
    return out.select("row", "hits", (F.size("hits") > 0).alias("contaminated"))


def benchmark_hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Digest: per document whether it is contaminated, by which items, and the words that verified overlaps cover."""
    out = decontaminate(docs, benchmark)
    return out.select(
        F.col("row.doc_id").alias("doc_id"), "contaminated", F.size("hits").cast("long").alias("n_items"),
        F.array_sort(F.transform("hits", lambda h: h["item_id"])).alias("item_ids"),
        F.aggregate("hits", F.lit(0).cast("long"), lambda a, h: F.greatest(a, h["n_equal"])).alias("most_equal"), "hits",
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without benchmark passages, with their own columns."""
    return decontaminate(docs, benchmark).where(~F.col("contaminated")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
