import hashlib
import random

import numpy as np
from pyspark.sql import functions as F
from tests.llm.util import corpus, empty, frame, long_text

from skarn.llm import substrings
from skarn.llm.bwt import covered_windows, intervals, suffix_order
from skarn.llm.substrings import dedup_substrings


def brute(rows, n=50):
    big = 2**63 - 1
    rank = lambda i: big if i is None else i
    first: dict = {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - n + 1):
            w = b[j : j + n]
            first[w] = min(first.get(w, big), rank(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - n + 1):
            if first[b[j : j + n]] < rank(i):
                gone[j : j + n] = b"\1" * n
        runs = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed, 60)
        assert got(dedup_substrings(frame(spark, rows))) == brute([(i, t) for i, t, _, _ in rows])


def test_long_texts_come_in_pieces(spark, monkeypatch):
    t = long_text(3000)
    rows = [(1, t, "", ""), (2, "head " + t[500:9000] + " tail " + t[9000:], "", ""), (3, "q" * 5000, "", ""), (4, "q" * 3000, "", "")]
    assert got(dedup_substrings(frame(spark, rows))) == brute([r[:2] for r in rows])


def test_pieces_overlap():
    data = np.frombuffer(long_text(4000).encode(), np.uint8)
    whole = [x for _, c, _ in substrings._pieces(data, np.array([0, len(data)]), 50) for x in [substrings.runs(c, 50, 20)]]
    assert len(whole) == 1
    old = substrings.PIECE, substrings.CHUNK
    try:
        substrings.PIECE, substrings.CHUNK = 1000, 500
        parts = [(b, *substrings.runs(c, 50, 20)) for _, c, b in substrings._pieces(data, np.array([0, len(data)]), 50)]
    finally:
        substrings.PIECE, substrings.CHUNK = old
    windows = {w + b: p + b for b, _, first, last, pos, _ in parts for f, la, p in zip(first, last, pos) for w in range(f, la + 1)}
    want = {w: p for _, first, last, pos, _ in whole for f, la, p in zip(first, last, pos) for w in range(f, la + 1)}
    assert windows == want


def test_small_blocks_split_hot_minimizers(spark):
    r = random.Random(4)
    core = "a very common phrase of text "
    rows = [(i, "".join(r.choice("xyz") for _ in range(r.randint(20, 26))) + core + "".join(r.choice("xy") for _ in range(5)), "", "") for i in range(80)]
    assert got(dedup_substrings(frame(spark, rows), block=200)) == brute([x[:2] for x in rows])


def test_intervals_are_the_common_prefixes():
    r = np.random.default_rng(3)
    s = r.integers(1, 4, 300)
    s[[100, 200, 299]] = 0
    order = suffix_order(s, 9)
    assert [tuple(s[i : i + 9]) for i in order] == sorted(tuple(s[i : i + 9]) for i in range(300))
    group = intervals(s, order, 6)
    for a, b, g, h in zip(order, order[1:], group, group[1:]):
        inside = a + 6 <= 300 and b + 6 <= 300 and (s[a : a + 6] > 0).all() and (s[b : b + 6] > 0).all()
        if inside:
            assert (g == h) == bool((s[a : a + 6] == s[b : b + 6]).all())


def test_covered_windows_by_brute_force():
    r = random.Random(9)
    texts = ["".join(r.choice("ab") for _ in range(r.randint(1, 40))).encode() for _ in range(30)]
    owner = np.array([r.randint(0, 5) for _ in texts])
    off = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    s, at = covered_windows(np.frombuffer(b"".join(texts), np.uint8), off, owner, 8)
    want = {(i, j) for i, t in enumerate(texts) for j in range(len(t) - 7) if any(t[j : j + 8] in u and owner[k] < owner[i] for k, u in enumerate(texts))}
    assert set(zip(s.tolist(), at.tolist())) == want


def test_empty(spark):
    assert dedup_substrings(empty(spark)).count() == 0
    assert got(dedup_substrings(frame(spark, [(1, None, "", ""), (2, "", "", "")]))) == brute([(1, None), (2, "")])


def test_ids_are_dealt_evenly_and_the_largest_is_an_id(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for step in (1, n, 64, 4096, 1 << 33):
        ids = np.arange(4000, dtype=np.int64) * step
        held = np.bincount(substrings._doc_bucket(ids, n), minlength=n)
        assert held.min() > 0.7 * len(ids) / n, (step, held)
    some = [0, 7, -5, 2**63 - 1, -(2**63), 10**12]
    got_ = spark.createDataFrame([(i,) for i in some], "rid long").select("rid", substrings._bucket_of(F.col("rid"), 13).alias("b")).collect()
    assert {r.rid: r.b for r in got_} == dict(zip(some, substrings._doc_bucket(np.array(some, np.int64), 13).tolist()))
    text = long_text(40)
    rows = [(2**63 - 1, text, "", ""), (None, text, "", ""), (8, "other " + text, "", ""), (16, "x", "", "")]
    assert got(dedup_substrings(frame(spark, rows))) == brute([r[:2] for r in rows])


def test_buckets_follow_the_size_of_the_texts(spark, monkeypatch):
    """More text gives more buckets, not larger ones, and ranges are gathered in parts."""
    monkeypatch.setattr(substrings, "BUCKET_BYTES", 3000)
    monkeypatch.setattr(substrings, "GATHER", 64)
    seen, expand = [], substrings._expand
    monkeypatch.setattr(substrings, "_expand", lambda n, *a: seen.append(n) or expand(n, *a))
    rows = corpus(5, 45)
    size = sum(len((t or "").encode()) for _, t, _, _ in rows)
    assert got(dedup_substrings(frame(spark, rows))) == brute([(i, t) for i, t, _, _ in rows])
    assert seen == [-(-size // 3000)] and seen[0] > 4
    at, size = np.array([5, 0, 90, 7]), np.array([80, 0, 10, 3])
    data = np.arange(100).astype(np.uint8)
    assert substrings._gather(data, at, size).tolist() == [*range(5, 85), *range(90, 100), 7, 8, 9]
