"""Byte-level BPE encoding and decoding (operator 13).

Texts are split as a rank file's usual pattern splits them (contractions, letters, numbers, other signs, each
with one space before it, and white space), without a regular expression:

1. every code point of a chunk of texts becomes a class (letter, number, other, white space), and with a
   look at its neighbours a symbol: an apostrophe that opens a contraction, a blank before a word, ...
2. each symbol is a transition function on eight states.  The functions that arise by composition are a
   finite monoid, so a function is one small number and composition a table.  An associative scan over these
   numbers gives the state before every code point at once, for all texts of the chunk;
3. state and symbol say whether a piece begins there.

Pieces are merged by rank with a bounded cache.  Every token keeps the byte at which it starts, and decoding
writes each token's bytes to its place.

A null or empty text has no tokens; its digests are those of no bytes.  Null and repeated ids are encoded like
others, one output row for each input row.  Bytes that are no UTF-8 become U+FFFD first.  The strings of
special tokens are ordinary text.  A text of any length is encoded whole, in n log n steps at worst; pieces
and the order in which equal ranks merge (the leftmost first) leave no ties.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that are classified at a time; a longer text is a chunk of its own.
CHUNK = 1 << 20
#: Pieces that a process remembers, and the longest of them in bytes.
CACHED, CACHED_BYTES = 1 << 18, 64
#: Pieces of more bytes are merged over a heap.
SCANNED = 200

# The White_Space property of Unicode, and the letters and numbers that version 16.0 added.
WHITE = [(0x9, 0xD), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
NEW_LETTERS = [
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B),
    (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
]
NEW_NUMBERS = [(0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA)]
# The letters after an apostrophe that make a contraction.
SHORT, LONG = "stmd", ("re", "ve", "ll")

# Symbols.  Of white space: INNER more of it follows or the text ends, BLANK a space before a word, BREAK another.
LETTER, NUMBER, OTHER, INNER, BLANK, BREAK, OPEN1, OPEN2 = range(8)
# States: what is open before a code point.  ONE and TWO: letters that a contraction still takes.
FRESH, LETTERS, NUMBERS, OTHERS, BLANKS, PREFIX, ONE, TWO = range(8)


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The next state, and whether a piece begins with this symbol."""
    if symbol == BLANK:
        return PREFIX, True
    if symbol == BREAK:
        return FRESH, True
    if symbol == LETTER and state in (ONE, TWO):
        return (FRESH if state == ONE else ONE), False
    if symbol in (OPEN1, OPEN2) and state not in (OTHERS, PREFIX):
        return (ONE if symbol == OPEN1 else TWO), True
    into = {LETTER: LETTERS, NUMBER: NUMBERS, INNER: BLANKS}.get(symbol, OTHERS)
    return into, not (state == into or (state == PREFIX and into != BLANKS))


class Monoid:
    """All transition functions that symbols make by composition, after a fresh start too, numbered from 0 (identity)."""

    def __init__(self):
        states, symbols = range(8), range(8)
        made = [tuple(step(s, x)[0] for s in states) for x in symbols]
        known = {tuple(states): 0}
        for f in [*made, (FRESH,) * 8]:
            known.setdefault(f, len(known))
        todo = list(known)
        for f in todo:
            for g in list(known):
                for h in (tuple(g[s] for s in f), tuple(f[s] for s in g)):
                    if h not in known:
                        known[h] = len(known)
                        todo.append(h)
        functions = list(known)
        self.size = len(functions)
        self.symbol = np.array([known[f] for f in made], np.uint8)
        self.after_start = np.array([known[(f[FRESH],) * 8] for f in made], np.uint8)
        self.then = np.array([known[tuple(g[s] for s in f)] for f in functions for g in functions], np.uint8)
        self.from_fresh = np.array([f[FRESH] for f in functions], np.uint8)
        self.begins = np.array([[step(s, x)[1] for x in symbols] for s in states], bool).ravel()

    def compose(self, f: np.ndarray, g: np.ndarray) -> np.ndarray:
        """First f, then g."""
        return self.then[f.astype(np.intp) * self.size + g]

    def scan(self, f: np.ndarray) -> np.ndarray:
        """The composition of f[0] to f[i] for every i: neighbours are composed, the pairs scanned, the gaps filled."""
        n = len(f)
        if n < 2:
            return f
        pairs = self.scan(self.compose(f[0 : n - 1 : 2], f[1::2]))
        out = np.empty_like(f)
        out[0], out[1::2] = f[0], pairs
        out[2::2] = self.compose(pairs[: len(out[2::2])], f[2::2])
        return out


@cache
def _tables() -> tuple[np.ndarray, Monoid]:
    """The class of every code point (LETTER, NUMBER, OTHER, INNER), and the functions."""
    kinds = {"L": LETTER, "N": NUMBER}
    classes = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    for kind, ranges in ((LETTER, NEW_LETTERS), (NUMBER, NEW_NUMBERS), (INNER, WHITE)):
        for a, b in ranges:
            classes[a : b + 1] = kind
    return classes, Monoid()


def symbols(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The symbol of every code point; starts: where (non-empty) texts begin."""
    classes, _ = _tables()
    n = len(points)
    out = classes[points]
    white = out == INNER
    ends = np.zeros(n + 2, bool)  # a text begins here, or nothing is left
    ends[starts], ends[n:] = True, True

    def next_is(k: int, letters: str) -> np.ndarray:
        """Whether the k-th code point after is one of letters; the text's end is not looked at."""
        hit = np.zeros(n, bool)
        hit[: max(n - k, 0)] = np.isin(points[k:], [ord(c) for c in letters])
        return hit

    goes_on = ~ends[1 : n + 1]
    before_word = white.copy()
    before_word[: n - 1] &= ~white[1:]
    before_word &= goes_on
    out[before_word] = BREAK
    out[before_word & (points == 0x20)] = BLANK
    quotes = (points == ord("'")) & goes_on
    if quotes.any():
        out[quotes & next_is(1, SHORT)] = OPEN1
        pair = np.zeros(n, bool)
        for a, b in LONG:
            pair |= next_is(1, a) & next_is(2, b)
        out[quotes & pair & ~ends[2 : n + 2]] = OPEN2
    return out


def boundaries(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indexes of the code points with which pieces begin, of all texts."""
    if not len(points):
        return np.zeros(0, np.int64)
    _, monoid = _tables()
    sym = symbols(points, starts)
    functions = monoid.symbol[sym]
    functions[starts] = monoid.after_start[sym[starts]]
    after = monoid.from_fresh[monoid.scan(functions)]
    before = np.empty_like(after)
    before[0], before[1:] = FRESH, after[:-1]
    before[starts] = FRESH
    return np.flatnonzero(monoid.begins[before.astype(np.intp) * 8 + sym])


class Coder(dict):
    """Pieces of bytes -> ids, remembered; and the vocabulary's bytes, end to end, for decoding."""

    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.length = np.full(size, -1, np.int64)
        self.at = np.zeros(size, np.int64)
        end, blob = 0, []
        for token, i in self.ranks.items():
            self.length[i], self.at[i] = len(token), end
            end += len(token)
            blob.append(token)
        self.blob = np.frombuffer(b"".join(blob), np.uint8)

    def __missing__(self, piece: bytes) -> tuple[int, ...]:
        ids = tuple(self.merge(piece))
        if len(piece) <= CACHED_BYTES:
            if len(self) >= CACHED:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, piece: bytes) -> list[int]:
        """Joins the neighbours of lowest rank, the leftmost first, until no two make a token."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        return self.scanned(piece) if len(piece) <= SCANNED else self.heaped(piece)

    def scanned(self, piece: bytes) -> list[int]:
        """Looks over all neighbours for each join: quick for short pieces."""
        rank, none = self.ranks.get, len(self.length)
        parts = list(range(len(piece) + 1))
        pairs = [rank(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < none:
            i = pairs.index(least)
            del parts[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = rank(piece[parts[i] : parts[i + 2]], none)
            if i:
                pairs[i - 1] = rank(piece[parts[i - 1] : parts[i + 1]], none)
        return [self.ranks[piece[a:b]] for a, b in zip(parts, parts[1:])]

    def heaped(self, piece: bytes) -> list[int]:
        """Keeps neighbours in a heap: n log n steps for long pieces."""
        ranks, n = self.ranks, len(piece)
        follows = list(range(1, n + 1))  # where the part that begins here ends; 0: no part begins here
        precedes = list(range(-1, n))
        heap = [(ranks[piece[i : i + 2]], i, i + 2) for i in range(n - 1) if piece[i : i + 2] in ranks]
        heapq.heapify(heap)

        def offer(i: int, end: int) -> None:
            r = ranks.get(piece[i:end])
            if r is not None:
                heapq.heappush(heap, (r, i, end))

        while heap:
            _, i, end = heapq.heappop(heap)
            j = follows[i]
            if not j or j >= n or follows[j] != end:
                continue  # one of the two has been joined meanwhile
            follows[i], follows[j] = end, 0
            if end < n:
                precedes[end] = i
                offer(i, follows[end])
            if precedes[i] >= 0:
                offer(precedes[i], end)
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : follows[i]]])
            i = follows[i]
        return out

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, and where each text's begin (one more at the end)."""
        data = b"".join(texts)
        string = data.decode("utf-8")
        points = np.frombuffer(string.encode("utf-32-le"), "<u4")
        width = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
        at = np.zeros(len(points) + 1, np.int64)  # the byte at which a code point begins
        np.cumsum(width, out=at[1:])
        text_at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=text_at[1:])
        first = np.searchsorted(at, text_at)  # the code point with which a text begins
        cuts = boundaries(points, np.unique(first[:-1][first[:-1] < first[1:]]))
        pieces = np.searchsorted(cuts, first).tolist()  # the piece with which a text begins
        ends = [*at[cuts].tolist(), len(data)]
        ids: list[int] = []
        starts = [0]
        for a, b in zip(pieces, pieces[1:]):
            for x, y in zip(ends[a:b], ends[a + 1 : b + 1]):
                ids += self[data[x:y]]
            starts.append(len(ids))
        return np.array(ids, np.int64), np.array(starts, np.int64)

    def starts(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The byte of its text at which each token starts."""
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.length[ids], out=at[1:])
        return at[:-1] - np.repeat(at[rows[:-1]], np.diff(rows))

    def decode(self, ids: np.ndarray, at: np.ndarray) -> bytes:
        """The bytes of one row of tokens, each written to the place at which it starts."""
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.length) or (self.length[ids] < 0).any():
            raise ValueError("an id that the vocabulary does not hold")
        n = self.length[ids]
        out = np.empty(int((at + n).max()), np.uint8)
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(at, n) + inside] = self.blob[np.repeat(self.at[ids], n) + inside]
        return out.tobytes()


@cache
def coder(ranks_path: str) -> Coder:
    """One for a process and rank file."""
    return Coder(ranks_path)


def _chunks(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about CHUNK bytes."""
    first, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > CHUNK:
            yield first, i
            first, held = i, 0
        held += n
    if first < len(sizes):
        yield first, len(sizes)


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and starts (array of int: the byte of the text at which each token starts)."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("starts", pa.list_(pa.int32()))])

    def run(batches):
        c = coder(ranks_path)
        for b in batches:
            sizes = [len(x) if x is not None else 0 for x in (v.as_buffer() for v in b.column(1))]
            for i, j in _chunks(sizes):
                texts = [bytes(v.as_buffer() or b"") for v in b.column(1).slice(i, j - i)]
                try:
                    ids, rows = c.encode(texts)
                except UnicodeDecodeError:
                    ids, rows = c.encode([t.decode("utf-8", "replace").encode() for t in texts])
                at = pa.array(rows.astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (ids, c.starts(ids, rows))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *lists], schema=schema)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return src.mapInArrow(run, "doc_id long, ids array<int>, starts array<int>")


def _rows(batch: pa.RecordBatch, c: Coder) -> Iterator[tuple[int | None, np.ndarray, bytes]]:
    """id, ids and decoded bytes of each row of encode(); a null row of ids or starts decodes as no bytes."""
    for i, ids, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
        a, b = (np.zeros(0, np.int64) if x.values is None else x.values.to_numpy().astype(np.int64) for x in (ids, at))
        yield i, a, c.decode(a, b)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and the decoded bytes of every row that encode() gave."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches):
        c = coder(ranks_path)
        for b in batches:
            rows = [(i, data) for i, _, data in _rows(b, c)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return encoded.select("doc_id", "ids", "starts").mapInArrow(run, "doc_id long, bytes binary")


def digests(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids and of the bytes that they decode to."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        c = coder(ranks_path)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            rows = [(i, len(ids), sha(ids.astype("<u4").tobytes()), sha(data)) for i, ids, data in _rows(b, c)]
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return encoded.select("doc_id", "ids", "starts").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def public_ranks() -> str:
    """Path of the installed public rank file, as an argument of encode() and decode()."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")
