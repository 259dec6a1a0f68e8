import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.util import corpus, empty, frame, long_text

from skarn.llm.packing import best_fit, cut_lengths, fit, pack, patterns, plan, public_tokenizer


def spread(steps):
    c = Counter()
    for lengths, n in steps:
        for v in lengths:
            c[v] += n
    return c


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_holds_every_piece_once(lengths):
    counts = np.bincount(lengths, minlength=65)
    steps = plan(counts, 64)
    assert spread(steps) == Counter(lengths) and all(0 < sum(p) <= 64 and n > 0 for p, n in steps)
    assert spread(best_fit(counts, 64)) == Counter(lengths)


def test_plan_is_close_to_the_bound():
    r = np.random.default_rng(1)
    counts = np.bincount(np.minimum(r.lognormal(4, 1, 20_000).astype(int) + 1, 256), minlength=257)
    used = sum(n for _, n in plan(counts, 256))
    assert used <= 1.01 * math.ceil((counts * np.arange(257)).sum() / 256)


def test_least_squares_leaves_little():
    counts = np.zeros(65, int)
    counts[[10, 20, 34, 44, 54]] = [50, 40, 40, 10, 40]
    pats = patterns([10, 20, 34, 44, 54], 64, 3)
    assert all(sum(p) == 64 for p in pats)
    x = fit(pats, counts, 50)
    assert (x >= 0).all()
    rest = counts.astype(float)
    for p, n in zip(pats, x):
        for v in p:
            rest[v] -= n
    assert np.abs(rest).sum() < 0.2 * counts.sum()


def test_cutting():
    assert cut_lengths(5, 4) == [1, 4] and cut_lengths(8, 4) == [4, 4] and cut_lengths(1, 4) == [1]


@pytest.fixture(scope="module")
def tokenizer():
    pytest.importorskip("public_tokenizers")
    return public_tokenizer()


def test_round_trip(spark, tokenizer):
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer["json_path"])
    rows = corpus(8, 45) + [(600, long_text(30_000), "", ""), (601, "a <|endoftext|> b", "", ""), (602, " " * 5000, "", ""), (603, "x" * 20_000, "", "")]
    out = pack(frame(spark, rows), **tokenizer).collect()
    pieces = Counter()
    for i, t, *_ in rows:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for k, n in enumerate(cut_lengths(len(ids), 1024)):
            pieces[i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())] += 1
            at += n
    assert pieces == Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out)
    seqs = defaultdict(list)
    for r in out:
        seqs[r.sequence_id].append((r.offset, r.length))
    for s in seqs.values():
        at = 0
        for off, n in sorted(s):
            assert off == at
            at += n
        assert at <= 1024
    assert len(seqs) <= 1.05 * math.ceil(sum(r.length for r in out) / 1024) + 1


def test_empty(spark, tokenizer):
    assert pack(empty(spark), **tokenizer).count() == 0
    assert [(r.length, r.offset) for r in pack(frame(spark, [(1, None, "", "")]), **tokenizer).collect()] == [(1, 0)]


def test_null_ids_are_packed_once_each(spark, tokenizer):
    rows = [(None, f"text number {i % 50} of nobody", "", "") for i in range(300)] + [(5, "text number 1 of nobody", "", "")] * 3
    out = pack(frame(spark, rows), **tokenizer).collect()
    assert len(out) == 303 and len({(r.sequence_id, r.offset) for r in out}) == 303
    assert all(r.offset + r.length <= 1024 for r in out)
