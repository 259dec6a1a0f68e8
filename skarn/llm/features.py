"""Per-document surface statistics over whole texts, computed in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from skarn.llm.textops import chunks, doc_keys, grams

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
    "n_distinct", "n_upper", "n_letters", "n_digits", "n_bang", "n_pipe", "n_lines", "n_varied",
)
WINDOW = 256


def _lut(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


_SYMBOL = _lut("#*$%&|<>")
_UPPER = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_LETTER = _lut("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_LETTER[0xC3:0xF5] = True  # the first byte of a multi-byte character counts as one letter
_DIGIT = _lut("0123456789")


def chunk_stats(c) -> dict[str, np.ndarray]:
    start, end = c.words()
    doc = c.doc_of(start)
    h = c.hashes(start, end)
    count = lambda d: np.bincount(d, minlength=c.n).astype(np.int64)
    out = {"n_words": count(doc), "word_chars": c.per_doc(c.word & ((c.data & 0xC0) != 0x80))}
    # lines with a word that equal an earlier line of their document
    ls, le = c.lines()
    ld = c.line_doc
    seen = np.concatenate([[0], np.cumsum(c.word)])
    full = seen[le] > seen[ls]
    keys = doc_keys(c.hashes(ls[full], le[full]), ld[full])
    _, first = np.unique(keys, return_index=True)
    out["n_lines"] = count(ld[full])
    out["n_dup_lines"] = out["n_lines"] - count(ld[full][first])
    # words inside a 3-word window that occurs at least twice in the document
    g, at = grams(h, doc, 3)
    k = doc_keys(g, doc[at])
    _, inverse, times = np.unique(k, return_inverse=True, return_counts=True)
    covered = np.zeros(len(h), bool)
    hit = at[times[inverse] > 1]
    for j in range(3):
        covered[hit + j] = True
    out["n_repeat_words"] = count(doc[covered])
    _, first = np.unique(doc_keys(h, doc), return_index=True)
    out["n_distinct"] = count(doc[first])
    # words that are new in their stretch of WINDOW words: unlike n_distinct, no smaller a share in longer texts
    place = np.arange(len(h)) - np.searchsorted(doc, doc)
    _, first = np.unique(doc_keys(h, doc * (1 << 32) + place // WINDOW), return_index=True)
    out["n_varied"] = count(doc[first])
    for name, t in (("n_symbols", _SYMBOL), ("n_upper", _UPPER), ("n_letters", _LETTER), ("n_digits", _DIGIT)):
        out[name] = c.per_doc(t[c.data])
    out["n_bang"] = c.per_doc(c.data == 33)
    out["n_pipe"] = c.per_doc(c.data == 124)
    return out


def document_stats(col: pa.Array) -> dict[str, np.ndarray]:
    """The STATS of each text of a column (null: as empty)."""
    parts = [chunk_stats(c) for c in chunks(col)]
    return {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in STATS}
