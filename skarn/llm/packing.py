"""Best-fit packing by length patterns and non-negative least squares (operator 7).

Every document becomes its token ids (byte-level BPE, no special tokens added) and a closing id; only those
longer than ``size`` are cut, into pieces of ``size`` with the shorter one first.  All that planning needs is
the histogram of piece lengths: at most ``size`` counts, summed with map-side aggregation.

The plan enumerates patterns of at most ``depth`` lengths that fill a sequence exactly, fits their repeat
counts to the histogram by non-negative least squares (cyclic coordinate descent), rounds down, gives back
what overshoots, and packs the residual pieces best-fit decreasing, on the histogram.  The plan is a list of
(lengths, repeats), bounded by the number of patterns and lengths, not by the corpus.  Pieces are then dealt
to the plan's places by their rank within their length; ranks come from bucket counts and prefix sums, so no
length, however common, is ordered in one task.

A null or empty text is one piece that holds the closing id alone.  Null and repeated ids are packed like
others; rows equal in id and text are interchangeable.  An empty table gives no pieces.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.session import cut

SIZE = 1024
END_ID = 2
DEPTH = 3
BUCKETS = 1024
_encoders: dict[tuple, tuple] = {}


def _encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """One function per process: text -> ids exactly as the tokenizer file at json_path gives them.

    The rank file is the same vocabulary in a form that is several times faster to apply; texts that spell
    out a special token, or that it cannot split, go to the tokenizer file itself.
    """
    key = (json_path, ranks_path)
    if key not in _encoders:
        from tokenizers import Tokenizer

        slow = Tokenizer.from_file(json_path)
        special = [t.content for t in slow.get_added_tokens_decoder().values()]
        exact = lambda text: slow.encode(text, add_special_tokens=False).ids
        if ranks_path is None:
            _encoders[key] = (exact,)
        else:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

            def encode(text: str):
                if any(s in text for s in special):
                    return exact(text)
                try:
                    return fast.encode_ordinary(text)
                except BaseException as e:  # the splitter gives up on some very long runs
                    if isinstance(e, (KeyboardInterrupt, SystemExit)):
                        raise
                    return exact(text)

            _encoders[key] = (encode,)
    return _encoders[key][0]


def cut_lengths(n: int, size: int) -> list[int]:
    """Lengths of the pieces of a document of n > 0 tokens."""
    first = (n - 1) % size + 1
    return [first] + [size] * ((n - first) // size)


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = SIZE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def run(it):
        encode = _encoder(json_path, ranks_path, pattern)
        for batch in it:
            rows: list[tuple] = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                at = 0
                for k, n in enumerate(cut_lengths(len(ids), size)):
                    rows.append((i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())))
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(lengths: list[int], size: int, depth: int) -> list[tuple[int, ...]]:
    """Descending tuples of two to depth of these lengths that sum to size."""
    have, out = sorted(lengths, reverse=True), []
    known = set(have)

    def extend(head: tuple[int, ...], room: int) -> None:
        top = head[-1] if head else size
        if len(head) >= 1 and room in known and room <= top:
            out.append((*head, room))
        if len(head) + 2 <= depth:
            for x in have:
                if x <= top and x < room and x * (depth - len(head)) >= room:
                    extend((*head, x), room - x)

    extend((), size)
    return out


def fit(pats: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = 6) -> np.ndarray:
    """Non-negative x that makes the patterns' summed lengths close to counts in least squares, by coordinate descent."""
    x = np.zeros(len(pats))
    rest = counts.astype(float).tolist()
    shape = []
    for p in pats:
        use: dict[int, int] = {}
        for v in p:
            use[v] = use.get(v, 0) + 1
        shape.append((tuple(use.items()), float(sum(n * n for n in use.values()))))
    for _ in range(sweeps):
        moved = 0.0
        for k, (use, norm) in enumerate(shape):
            g = sum(n * rest[v] for v, n in use) / norm
            new = x[k] + g
            step = (new if new > 0 else 0.0) - x[k]
            if step:
                x[k] += step
                for v, n in use:
                    rest[v] -= n * step
                moved = max(moved, abs(step))
        if moved < 0.5:
            break
    return x


def best_fit(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths, repeats) of the sequences."""
    rooms: dict[int, list[list]] = {}
    for v in range(len(counts) - 1, 0, -1):
        left = int(counts[v])
        while left:
            fits = [s for s in rooms if s >= v and rooms[s]]
            if fits:
                s = min(fits)
                pat, n = rooms[s].pop()
                if not rooms[s]:
                    del rooms[s]
                take = min(n, left)
                if n > take:
                    rooms.setdefault(s, []).append([pat, n - take])
                rooms.setdefault(s - v, []).append([(*pat, v), take])
            else:
                per = size // v
                take = left // per
                if take:
                    rooms.setdefault(size - per * v, []).append([(v,) * per, take])
                    left -= take * per
                if left:
                    rooms.setdefault(size - left * v, []).append([(v,) * left, 1])
                take = left
            left -= take
    total: dict[tuple[int, ...], int] = {}
    for groups in rooms.values():
        for pat, n in groups:
            total[pat] = total.get(pat, 0) + n
    return sorted(total.items(), reverse=True)


def plan(counts: np.ndarray, size: int = SIZE, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) of all sequences for counts[length] pieces."""
    out = [((size,), int(counts[size]))] if counts[size] else []
    rest = counts.astype(np.int64).copy()
    rest[size] = 0
    pats = patterns([int(v) for v in np.flatnonzero(rest)], size, depth)
    times = np.floor(fit(pats, rest) + 1e-9).astype(np.int64)
    left = rest.copy()
    for p, n in zip(pats, times):
        for v in p:
            left[v] -= n
    for k in np.argsort(times, kind="stable"):  # give back what overshoots, from the least used patterns
        while times[k] and any(left[v] < 0 for v in pats[k]):
            over = max(-(left[v] // pats[k].count(v)) for v in pats[k] if left[v] < 0)
            n = int(min(times[k], over))
            times[k] -= n
            for v in pats[k]:
                left[v] += n
    out += [(p, int(n)) for p, n in zip(pats, times) if n]
    return out + best_fit(left, size)


def places(steps: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """The plan by length: key (length and first rank), first rank, first sequence, offset, sorted by key."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for pat, n in steps:
        at = 0
        for v in pat:
            r = used.get(v, 0)
            rows.append((v, r, base, at))
            used[v] = r + n
            at += v
        base += n
    rows.sort()
    a = np.array(rows, np.int64).reshape(len(rows), 4)
    return (a[:, 0] << 44) + a[:, 1], a[:, 1], a[:, 2], a[:, 3]


def pack(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, size: int = SIZE, buckets: int = BUCKETS) -> DataFrame:
    """Every piece with its sequence and offset."""
    rows = cut(pieces(docs, json_path, ranks_path, pattern, size).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "start"), F.lit(buckets)).cast("int")))
    counts = np.zeros(size + 1, np.int64)
    for r in rows.groupBy("length").count().collect():  # at most size rows
        counts[r["length"]] = r["count"]
    key, first, seq, off = places(plan(counts, size))

    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        n, r = length.to_numpy(zero_copy_only=False).astype(np.int64), rank.to_numpy(zero_copy_only=False)
        k = np.searchsorted(key, (n << 44) + r, side="right") - 1
        return pa.StructArray.from_arrays([pa.array(seq[k] + r - first[k]), pa.array(off[k])], ["sequence_id", "offset"])

    groups = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    start = groups.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    w = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = rows.join(start, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(w) - 1)
    placed = ranked.withColumn("at", F.arrow_udf(place, "sequence_id long, offset long")("length", "rank"))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", F.col("at.sequence_id").alias("sequence_id"), F.col("at.offset").alias("offset"))


def public_tokenizer() -> dict[str, str]:
    """Paths of the installed public vocabulary, as arguments of pack()."""
    import public_tokenizers

    return {"json_path": public_tokenizers.path("byte_bpe_50k.json"), "ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN}
