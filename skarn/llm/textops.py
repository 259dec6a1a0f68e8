"""Vectorised byte-level text primitives shared by the operators of this subpackage.

Everything works on the UTF-8 bytes of Arrow string columns, chunk by chunk, so that memory stays
bounded by ``CHUNK`` bytes of text (or one document, if that is longer) whatever the batch size.

Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; that set is ASCII, so byte-level and
code-point-level tokenisation agree.  Hashes are 64-bit polynomial hashes over random byte values,
finished by a mixing step; equal content always gives equal hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

CHUNK = 1 << 19
U64 = np.uint64
_R = 0x9E3779B97F4A7C15
_RINV = pow(_R, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers = [np.ones(1, U64), np.ones(1, U64)]


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in ((0, _R), (1, _RINV)):
            p = np.full(max(n, CHUNK + 4096), base, U64)
            p[0] = 1
            _powers[k] = np.cumprod(p)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    h = h ^ (h >> U64(32))
    h = h * U64(0xD6E8FEB86659FD93)
    h ^= h >> U64(29)
    h *= U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def raw(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is empty."""
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    if col.null_count:
        col = pa.compute.fill_null(col, b"" if "binary" in str(col.type) else "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int32)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets.astype(np.int64)


class Chunk:
    """Some whole documents of a batch: bytes, document offsets, and lazily words and hashes."""

    def __init__(self, first: int, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.first, self.n = first, len(offsets) - 1
        self.data = _LOWER[data] if lower else data
        self.off = offsets
        self.brk = np.zeros(len(data) + 1, bool)
        self.brk[offsets] = True
        self.word = ~_SPACE[self.data]
        self._prefix = None

    @property
    def prefix(self) -> np.ndarray:
        if self._prefix is None:
            n = len(self.data)
            pw, _ = _tables(n + 1)
            self._prefix = np.zeros(n + 1, U64)
            np.cumsum(_BYTE[self.data] * pw[:n], out=self._prefix[1:])
        return self._prefix

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the byte ranges [start, end)."""
        p, inv = self.prefix, _tables(len(self.data) + 1)[1]
        return mix((p[end] - p[start]) * inv[start])

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words; none crosses a document's end."""
        w = self.word
        before = np.empty_like(w)
        before[:1], before[1:] = False, w[:-1]
        start = np.flatnonzero(w & (self.brk[:-1] | ~before))
        after = np.empty_like(w)
        after[-1:], after[:-1] = False, w[1:]
        return start, np.flatnonzero(w & (self.brk[1:] | ~after)) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of \\n-split lines, empty ones included; an empty document has one empty line."""
        nl = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.off[:-1], nl + 1])
        end = np.concatenate([self.off[1:], nl])
        # a newline that ends a document starts that document's last, empty line
        doc = np.concatenate([np.arange(self.n), self.doc_of(nl)])
        o = np.lexsort((start, doc))
        start, doc = start[o], doc[o]
        end = np.concatenate([self.off[1:], nl])[np.lexsort((end, np.concatenate([np.arange(self.n), self.doc_of(nl)])))]
        self.line_doc = doc
        return start, end

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        """Index in the chunk of the document that holds byte pos."""
        return np.searchsorted(self.off, pos, side="right") - 1

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a byte-wise array over each document."""
        c = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return c[self.off[1:]] - c[self.off[:-1]]


def chunks(col: pa.Array, lower: bool = False):
    """Chunks of about CHUNK bytes that cover all rows of the column, in order."""
    data, off = raw(col)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1)
        j = min(j, n)
        yield Chunk(i, data[off[i] : off[j]], off[i : j + 1] - off[i], lower)
        i = j


_EDGE = np.zeros(256, bool)
_EDGE[[ord(x) for x in ".,;:!?\"'()[]%&$#*"]] = True


def plain_hashes(c: Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Word hashes without the punctuation at the word's edges, however much, but for one last character; c should be lower-cased."""
    if not len(start):
        return c.hashes(start, end)
    at = np.arange(len(c.data))
    inner = ~_EDGE[c.data]
    before = np.maximum.accumulate(np.where(inner, at, -1))
    after = np.minimum.accumulate(np.where(inner, at, len(c.data))[::-1])[::-1]
    e = np.maximum(before[end - 1] + 1, start + 1)
    return c.hashes(np.minimum(after[start], e - 1), e)


def grams(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word windows within a document, and the index of each one's first word."""
    m = len(words) - k + 1
    if m <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    at = np.flatnonzero(doc[:m] == doc[k - 1 :])
    h = np.zeros(len(at), U64)
    for j in range(k):
        h = h * U64(0xF1357AEA2E62A9C5) + words[at + j]
    return mix(h), at


def doc_keys(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes that differ between documents, to find repeats within one."""
    return mix(h + mix(doc.astype(U64) + U64(1)))


def batches(rows: dict[str, np.ndarray | list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type, from_pandas=False) for f in schema], schema=schema)
