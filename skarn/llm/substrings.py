"""Suffix-array dedup of long common substrings (operator 2).

Every byte covered by a ``length``-byte string that also starts in a document of a smaller id is removed;
strings never cross documents and are judged on the input.  The common substrings come from a Burrows-Wheeler
transform by threshold-bounded interval expansion (``bwt``).  No machine can hold the transform of a corpus,
so the text is first cut into pieces that can be judged apart without missing a match:

1. The minimizer of a window is the smallest hash of the k-byte strings in it: equal windows have equal
   minimizers.  Minimizers are grouped over the corpus; only those seen in two documents matter.
2. For each of these, the run of windows that it is the minimizer of forms a segment (at most
   2 * length - k bytes).  Segments are grouped by minimizer, so equal windows meet in one group.
3. Equal segments collapse to the smallest id, first where they are made: in all other documents they are
   covered outright.  A passage in every document costs one segment per task.
4. Blocks of distinct segments are transformed, and intervals expanded to ``length``; windows whose interval
   holds a smaller id are covered.  A minimizer with more segments than a block is split by the hash of the
   window, so that blocks stay bounded.

Rows carry packed arrays ("blobs") for a bucket.  There are as many buckets as shuffle partitions, and more where a
bucket would have more than BUCKET_BYTES of text: a task takes its buckets one by one, so what it holds does not grow
with the corpus.  Texts are shuffled once, by id.

A null text is empty.  A null id is larger than all others, and null ids are equal.  Rows of one id are never
compared with each other; rows equal in id and text have equal results.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.bwt import covered_windows
from skarn.llm.session import width
from skarn.llm.textops import CHUNK, U64, Chunk, mix, raw

LENGTH = 50
K = 20
BLOCK = 1 << 20
PIECE = 8 << 20
GATHER = 1 << 20
#: Bytes of text of a bucket, on average.
BUCKET_BYTES = 8 << 20
_NONE = 2**63 - 1
_LOW = U64((1 << 24) - 1)
_CODEC = "zstd"


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of any types as one compressed value."""
    heads = ",".join(f"{a.dtype.str}:{len(a)}" for a in arrays).encode()
    body = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    packed = pa.compress(body, codec=_CODEC, asbytes=True) if body else b""
    return len(heads).to_bytes(4, "little") + len(body).to_bytes(8, "little") + heads + packed


def _open(blob: bytes) -> list[np.ndarray]:
    h, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:12], "little")
    body = pa.decompress(blob[12 + h :], decompressed_size=size, codec=_CODEC, asbytes=True) if size else b""
    out, at = [], 0
    for spec in blob[12 : 12 + h].decode().split(","):
        kind, n = spec.split(":")
        a = np.frombuffer(body, kind, int(n), at)
        out.append(a)
        at += a.nbytes
    return out


def _pieces(data: np.ndarray, off: np.ndarray, length: int):
    """(first document, chunk, base): chunks of whole documents; a longer document comes in overlapping pieces at base."""
    i, n = 0, len(off) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1))
        size = off[j] - off[i]
        if size <= PIECE:
            yield i, Chunk(i, data[off[i] : off[j]], off[i : j + 1] - off[i]), 0
        else:
            for base in range(0, int(size), PIECE):
                part = data[off[i] + base : min(off[j], off[i] + base + PIECE + length - 1)]
                if len(part) >= length:
                    yield i, Chunk(i, part, np.array([0, len(part)])), base
        i = j


def runs(c: Chunk, length: int, k: int) -> tuple[np.ndarray, ...]:
    """Of a chunk: document, first and last window, minimizer position and minimizer of each run of windows."""
    n = len(c.data)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, U64),)
    if n < length:
        return none
    at = np.arange(n - k + 1)
    h = c.hashes(at, at + k)
    key = (h & ~_LOW) | at.astype(U64)
    w = length - k + 1
    m, s = key, 1
    while s * 2 <= w:
        m = np.minimum(m[:-s], m[s:])
        s *= 2
    if s < w:
        m = np.minimum(m[: len(key) - w + 1], m[w - s :])
    pos = (m & _LOW).astype(np.int64)
    doc = np.repeat(np.arange(c.n), np.diff(c.off))
    window = np.flatnonzero(doc[: len(m)] == doc[length - 1 :])
    if not len(window):
        return none
    p, d = pos[window], doc[window]
    new = np.ones(len(window), bool)
    new[1:] = (p[1:] != p[:-1]) | (d[1:] != d[:-1])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(window)]]) - 1
    return d[first], window[first], window[last], p[first], h[p[first]]


def _deal(bucket: np.ndarray, n: int):
    """(bucket, members) for each bucket that has any."""
    o = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[o], np.arange(n + 1))
    for b in range(n):
        if cuts[b] < cuts[b + 1]:
            yield b, o[cuts[b] : cuts[b + 1]]


#: Odd multipliers under 2**32: a product with 31 bits stays a positive long.
_DEAL_LOW, _DEAL_HIGH, _HALF = 2654435761, 2246822519, 2**31 - 1


def _doc_bucket(rid: np.ndarray, n: int) -> np.ndarray:
    """The bucket of a document by a hash of its id; _bucket_of() says the same to Spark."""
    return ((((rid & _HALF) * _DEAL_LOW) ^ (((rid >> 31) & _HALF) * _DEAL_HIGH)) >> 24) % n


def _bucket_of(rid: Column, n: int) -> Column:
    low, high = rid.bitwiseAND(F.lit(_HALF)), F.shiftright(rid, 31).bitwiseAND(F.lit(_HALF))
    return (F.shiftright((low * F.lit(_DEAL_LOW)).bitwiseXOR(high * F.lit(_DEAL_HIGH)), 24) % F.lit(n)).cast("long")


_ROWS = pa.schema([("bucket", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
_DDL = "bucket long, kind int, blob binary"


def _table(rows: list[tuple], schema: pa.Schema = _ROWS) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _gather(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of ranges, one after the other; their places, eight bytes each, are made for about GATHER bytes at a time."""
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(at[-1]), data.dtype)
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(at, at[i] + GATHER, side="right")) - 1)
        out[at[i] : at[j]] = data[np.repeat(start[i:j] - (at[i:j] - at[i]), size[i:j]) + np.arange(at[j] - at[i])]
        i = j
    return out


def _starts(h: np.ndarray) -> np.ndarray:
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    return new


def _minimizers(n: int, length: int, k: int):
    """Step 1, map side: blobs (minimizer, id, position, shared) per bucket.

    A minimizer of several documents of the batch is known to be shared: only the smallest id's places go to
    its bucket, the others straight on (kind 1).
    """

    def run(it):
        for batch in it:
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = raw(batch.column(1))
            parts = []
            for first, c, base in _pieces(data, off, length):
                d, _, _, p, h = runs(c, length, k)
                parts.append((h, rid[first + d], p - c.off[d] + base))
            if not parts:
                continue
            h, r, p = (np.concatenate(x) for x in zip(*parts))
            o = np.lexsort((r, h))
            g = np.cumsum(_starts(h[o])) - 1
            begin = np.flatnonzero(_starts(h[o]))
            end = np.concatenate([begin[1:], [len(o)]]) - 1
            several = np.zeros(len(h), bool)
            least = np.zeros(len(h), bool)
            several[o] = (r[o][begin] != r[o][end])[g] if len(o) else False
            least[o] = r[o] == r[o][begin][g] if len(o) else False
            asked = ~several | least
            bucket = (h % U64(n)).astype(np.int64)
            rows = []
            for b, at in _deal(bucket[asked], n):
                at = np.flatnonzero(asked)[at]
                rows.append((b, 0, _blob(h[at], r[at], p[at].astype(np.uint32), several[at])))
            known = np.flatnonzero(~asked)
            for b, at in _deal(_doc_bucket(r[known], n), n):
                rows.append((b, 1, _blob(r[known][at], p[known][at].astype(np.uint32))))
            yield from _table(rows).to_batches()

    return run


def _shared(n: int):
    """Step 1, per bucket: places of minimizers that two documents have, dealt by document."""

    def run(table: pa.Table) -> pa.Table:
        asked, out = [], []
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"]):
            (asked if kind == 0 else out).append(_open(blob.as_py()))
        if asked:
            h, r, p, several = (np.concatenate(x) for x in zip(*asked))
            o = np.lexsort((r, h))
            h, r, p, several = h[o], r[o], p[o], several[o]
            begin = np.flatnonzero(_starts(h))
            g = np.cumsum(_starts(h)) - 1
            end = np.concatenate([begin[1:], [len(h)]]) - 1
            yes = ((r[begin] != r[end]) | np.logical_or.reduceat(several, begin))[g] if len(h) else np.zeros(0, bool)
            out.append([r[yes], p[yes]])
        r, p = (np.concatenate(x) for x in zip(*out))
        return _table([(b, 0, _blob(r[at], p[at])) for b, at in _deal(_doc_bucket(r, n), n)])

    return run


def _content(c: Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each segment, wherever it stands."""
    return mix(c.hashes(start, end) + (end - start).astype(U64))


def _segments(n: int, length: int, k: int):
    """Step 2: segments of the shared minimizers of a bucket of documents; step 3 among them.

    kind 0: distinct segments by minimizer's bucket; kind 1: covered ranges, by document's bucket.
    """

    def run(docs: pa.Table, places: pa.Table) -> pa.Table:
        if not docs.num_rows or not places.num_rows:
            return _table([])
        r, p = (np.concatenate(x) for x in zip(*(_open(b.as_py()) for b in places["blob"])))
        wanted = np.unique(np.column_stack([r, p.astype(np.int64)]), axis=0)
        docs = docs.combine_chunks().sort_by("rid")
        rid, tk = docs["rid"].to_numpy(), docs["tk"].to_numpy()
        data, off = raw(docs["text"].combine_chunks() if isinstance(docs["text"], pa.ChunkedArray) else docs["text"])
        lo, hi = np.searchsorted(wanted[:, 0], rid, "left"), np.searchsorted(wanted[:, 0], rid, "right")
        parts, text = [], []
        for first, c, base in _pieces(data, off, length):
            d, a, b, pos, h = runs(c, length, k)
            if not len(d):
                continue
            # keep the runs whose minimizer's place is wanted
            docs_of = first + d
            local = pos - c.off[d] + base
            keep = np.zeros(len(d), bool)
            for x in np.unique(docs_of):
                mine = np.flatnonzero(docs_of == x) if c.n == 1 else slice(*np.searchsorted(docs_of, [x, x + 1]))
                w = wanted[lo[x] : hi[x], 1]
                if len(w):
                    i = np.minimum(np.searchsorted(w, local[mine]), len(w) - 1)
                    keep[mine] = w[i] == local[mine]
            d, a, b, h, docs_of = d[keep], a[keep], b[keep], h[keep], docs_of[keep]
            if not len(d):
                continue
            e = b + length
            own = _content(c, a, e)
            start = a - c.off[d] + base
            parts.append((h, own, rid[docs_of], tk[docs_of], start, e - a))
            size = e - a
            text.append(_gather(c.data, a, size))
        if not parts:
            return _table([])
        h, own, r, t, start, size = (np.concatenate(x) for x in zip(*parts))
        return _collapse(n, h, own, r, t, start, size, np.concatenate(text), length, None)

    return run


def _ranges(n: int, r: np.ndarray, t: np.ndarray, s: np.ndarray, e: np.ndarray) -> list[tuple]:
    """Rows of kind 1 of covered ranges, merged where they touch."""
    if not len(r):
        return []
    o = np.lexsort((e, s, t, r))
    r, t, s, e = r[o], t[o], s[o], e[o]
    same = np.zeros(len(r), bool)
    same[1:] = (r[1:] == r[:-1]) & (t[1:] == t[:-1]) & (s[1:] <= e[:-1])
    begin = np.flatnonzero(~same)
    r, t, s, e = r[begin], t[begin], s[begin], np.maximum.reduceat(e, begin)
    return [(b, 1, _blob(r[at], t[at], s[at], e[at])) for b, at in _deal(_doc_bucket(r, n), n)]


def _collapse(n, h, own, r, t, start, size, text, length, judge):
    """Equal segments keep their smallest id; the rest is covered.  judge: what to do with those kept (None: send them on)."""
    off = np.concatenate([[0], np.cumsum(size)])
    o = np.lexsort((r, own, h))
    new = _starts(h[o]) | _starts(own[o])
    g = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    gone = r[o] > r[o][begin][g]
    out = _ranges(n, r[o][gone], t[o][gone], start[o][gone], start[o][gone] + size[o][gone])
    stay, content = o[~gone], g[~gone]  # places in the smallest id (it may hold the segment several times)
    kept = o[begin]
    length_of = size[kept]
    body = _gather(text, off[kept], length_of)
    if judge is None:
        body_off = np.concatenate([[0], np.cumsum(length_of)])
        place_at = np.searchsorted(content, np.arange(len(kept) + 1))
        for b, at in _deal((h[kept] % U64(n)).astype(np.int64), n):
            m = length_of[at]
            part = _gather(body, body_off[at], m)
            cnt = place_at[at + 1] - place_at[at]
            pl = stay[np.repeat(place_at[at], cnt) + np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)]
            out.append((b, 0, _blob(h[kept][at], m.astype(np.uint32), cnt.astype(np.uint32), r[pl], t[pl], start[pl].astype(np.uint32), part)))
        return _table(out)
    return _table(out + judge(h[kept], r[kept], length_of, body, stay, content, r, t, start))


def _blocks(h: np.ndarray, size: np.ndarray, limit: int):
    """Slices of whole minimizer groups (h is sorted) of about limit bytes; a larger group comes alone."""
    begin = np.concatenate([np.flatnonzero(_starts(h)), [len(h)]])
    total = np.concatenate([[0], np.cumsum(size)])
    i = 0
    while i < len(begin) - 1:
        j = i + 1
        while j < len(begin) - 1 and total[begin[j + 1]] - total[begin[i]] <= limit:
            j += 1
        yield begin[i], begin[j]
        i = j


def _judge(n: int, length: int, block: int):
    """Step 4 for the distinct segments of a bucket."""

    def judge(h, owner, size, body, stay, content, r, t, start):
        off = np.concatenate([[0], np.cumsum(size)])
        found_s, found_at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        begin = np.flatnonzero(_starts(h))
        several = np.repeat(np.diff(np.concatenate([begin, [len(h)]])) > 1, np.diff(np.concatenate([begin, [len(h)]])))
        some = np.flatnonzero(several)  # a minimizer's only segment has nothing left to match
        m = size[some]
        body = _gather(body, off[some], m)
        h, owner, size, off = h[some], owner[some], m, np.concatenate([[0], np.cumsum(m)])
        for lo, hi in _blocks(h, size, block):
            part, o = body[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
            if off[hi] - off[lo] <= 2 * block:
                s, at = covered_windows(part, o, owner[lo:hi], length)
                found_s.append(s + lo)
                found_at.append(at)
                continue
            # one minimizer with very many segments: single windows, split by their hash
            c = Chunk(0, part, o)
            m = np.diff(o) - length + 1
            string = np.repeat(np.arange(hi - lo), m)
            at = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            begin = o[:-1][string] + at
            cls = c.hashes(begin, begin + length) % U64(-(-len(begin) * length // block))
            for x in np.unique(cls):
                k = np.flatnonzero(cls == x)
                w = part[(begin[k][:, None] + np.arange(length)).ravel()]
                s, _ = covered_windows(w, np.arange(len(k) + 1) * length, owner[lo:hi][string[k]], length)
                found_s.append(string[k[s]] + lo)
                found_at.append(at[k[s]])
        s, at = np.concatenate(found_s), np.concatenate(found_at)
        o = np.lexsort((at, s))
        s, at = s[o], at[o]
        if not len(s):
            return []
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(s)]]) - 1
        s, a, e = some[s[first]], at[first], at[last] + length
        lo, hi = np.searchsorted(content, s, "left"), np.searchsorted(content, s, "right")
        cnt = hi - lo
        k = np.repeat(np.arange(len(s)), cnt)
        pl = stay[np.repeat(lo, cnt) + np.arange(cnt.sum()) - np.repeat(np.cumsum(cnt) - cnt, cnt)]
        return _ranges(n, r[pl], t[pl], start[pl] + a[k], start[pl] + e[k])

    return judge


def _expand(n: int, length: int, block: int):
    """Steps 3 and 4, per bucket of minimizers; covered ranges found before pass through."""

    def run(table: pa.Table) -> pa.Table:
        parts, through = [], []
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"]):
            if kind == 1:
                through.append(_open(blob.as_py()))
                continue
            h, m, cnt, r, t, start, body = _open(blob.as_py())
            k = np.repeat(np.arange(len(h)), cnt)
            o = np.concatenate([[0], np.cumsum(m.astype(np.int64))])
            own = _content(Chunk(0, body, o), o[:-1], o[1:])
            size = m.astype(np.int64)[k]
            text = _gather(body, o[k], size) if (cnt > 1).any() else body
            parts.append((h[k], own[k], r, t, start.astype(np.int64), size, text))
        rows = _ranges(n, *(np.concatenate(x) for x in zip(*through))) if through else []
        out = [_table(rows)]
        if parts:
            h, own, r, t, start, size, text = (np.concatenate(x) for x in zip(*parts))
            out.append(_collapse(n, h, own, r, t, start, size, text, length, _judge(n, length, block)))
        return pa.concat_tables(out)

    return run


_DONE = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
_DONE_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: bigint, end: bigint>>"


def _remove(docs: pa.Table, ranges: pa.Table) -> pa.Table:
    """Per document: what its covered ranges leave."""
    if not docs.num_rows:
        return _DONE.empty_table()
    found = [_open(b.as_py()) for b in ranges["blob"]] if ranges.num_rows else []
    r, t, s, e = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    o = np.lexsort((s, t, r))
    r, t, s, e = r[o], t[o], s[o], e[o]
    rows = []
    docs = docs.combine_chunks()
    rid, tk, nameless = docs["rid"].to_numpy(), docs["tk"].to_numpy(), docs["nameless"].to_pylist()
    column = docs["text"].combine_chunks() if isinstance(docs["text"], pa.ChunkedArray) else docs["text"]
    data, off = raw(column)
    lo, hi = np.searchsorted(r, rid, "left"), np.searchsorted(r, rid, "right")
    for i in range(len(rid)):
        text = data[off[i] : off[i + 1]]
        mine = slice(lo[i] + np.searchsorted(t[lo[i] : hi[i]], tk[i], "left"), lo[i] + np.searchsorted(t[lo[i] : hi[i]], tk[i], "right"))
        spans: list[list[int]] = []
        for a, b in zip(s[mine].tolist(), e[mine].tolist()):
            if spans and a <= spans[-1][1]:
                spans[-1][1] = max(spans[-1][1], b)
            else:
                spans.append([a, b])
        at, sha = 0, hashlib.sha256()
        for a, b in spans:
            sha.update(text[at:a])
            at = b
        sha.update(text[at:])
        rows.append((None if nameless[i] else int(rid[i]), len(text), sum(b - a for a, b in spans), len(spans), sha.hexdigest(), [{"start": a, "end": b} for a, b in spans]))
    return _table(rows, _DONE)


def dedup_substrings(docs: DataFrame, length: int = LENGTH, k: int = K, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte spans of every document."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    n = max(width(docs.sparkSession), -(-size // BUCKET_BYTES))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("rid"), text.cast("binary").alias("text"), F.col(id_col).cast("long").isNull().alias("nameless")).withColumn("tk", F.xxhash64("text"))
    mini = rows.select("rid", "text").mapInArrow(_minimizers(n, length, k), _DDL)
    places = mini.groupBy("bucket").applyInArrow(_shared(n), _DDL)
    dealt = rows.withColumn("bucket", _bucket_of(F.col("rid"), n)).groupBy("bucket")
    segments = dealt.cogroup(places.groupBy("bucket")).applyInArrow(_segments(n, length, k), _DDL)
    ranges = segments.groupBy("bucket").applyInArrow(_expand(n, length, block), _DDL)
    return dealt.cogroup(ranges.groupBy("bucket")).applyInArrow(_remove, _DONE_DDL)
