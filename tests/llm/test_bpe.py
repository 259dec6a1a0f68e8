import base64
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.util import corpus, empty, frame, long_text

from skarn.llm import bpe


@pytest.fixture(scope="module")
def ranks():
    pytest.importorskip("public_tokenizers")
    return bpe.public_ranks()


@pytest.fixture(scope="module")
def exact(ranks):
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def test_few_functions_compose_as_functions():
    m = bpe.Monoid()
    assert m.size < 64 and m.symbol.max() < m.size
    state = lambda f, s: bpe.step(s, f)[0]
    for x in range(8):
        for y in range(8):
            both = m.then[int(m.symbol[x]) * m.size + int(m.symbol[y])]
            assert m.from_fresh[both] == state(y, state(x, bpe.FRESH))


def test_scan_equals_a_loop():
    m = bpe.Monoid()
    r = np.random.default_rng(3)
    for n in (0, 1, 2, 3, 7, 64, 1001):
        f = m.symbol[r.integers(0, 8, n)]
        want, state = [], 0
        for x in f:
            state = m.then[state * m.size + int(x)]
            want.append(state)
        assert m.scan(f).tolist() == want


SIGNS = ["'", "'", "s", "t", "r", "e", "v", "l", "m", "d", "S", " ", " ", "\n", "\t", " ", "　", "\x1c", "\x85", "1", "²", "é", "é", "日", "ا", "!", "-", "😀", "\U00016d40", "\U0001ccf0", "\0"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=40), st.lists(st.sampled_from(SIGNS), max_size=24).map("".join)))
def test_equals_the_library(exact, ranks, text):
    c = bpe.coder(ranks)
    text = text.encode("utf-8", "replace").decode()
    ids, rows = c.encode([b"", text.encode(), b"'s x"])  # neighbours must not matter
    mine = ids[rows[1] : rows[2]]
    assert mine.tolist() == exact.encode_ordinary(text)
    at = c.starts(ids, rows)[rows[1] : rows[2]]
    assert c.decode(mine, at) == text.encode()
    assert all(text.encode()[a:].startswith(exact.decode_single_token_bytes(i)) for a, i in zip(at, mine))


def test_every_code_point_is_classed_as_the_library_does(exact, ranks):
    c = bpe.coder(ranks)
    points = [chr(p) for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for i in range(0, len(points), 1 << 17):
        text = "".join("a" + p + "1" + p for p in points[i : i + (1 << 17)])
        assert c.encode([text.encode()])[0].tolist() == exact.encode_ordinary(text)


def test_both_ways_of_merging_agree(ranks):
    c = bpe.coder(ranks)
    r = random.Random(5)
    for _ in range(500):
        piece = "".join(r.choice("abenrst日é") for _ in range(r.randint(2, 60))).encode()
        assert c.scanned(piece) == c.heaped(piece)


def test_the_cache_is_bounded(ranks, monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 10)
    c = bpe.Coder(ranks)
    for i in range(50):
        c[b"word%d" % i]
        assert len(c) <= 10
    c[b"x" * 100]
    assert b"x" * 100 not in c


def odd_rows():
    return corpus(21, 45) + [(700, long_text(30_000), "", ""), (701, "a <|endoftext|> b", "", ""), (702, " " * 5000, "", ""), (703, "x" * 20_000, "", ""), (704, "日本" * 3000, "", "")]


def test_encode_and_decode(spark, exact, ranks, monkeypatch):
    rows = odd_rows()
    encoded = bpe.encode(frame(spark, rows), ranks)
    want = sorted(repr((i, exact.encode_ordinary(t or ""))) for i, t, *_ in rows)
    assert sorted(repr((r.doc_id, r.ids)) for r in encoded.collect()) == want
    back = bpe.decode(encoded, ranks).collect()
    assert sorted(repr((r.doc_id, bytes(r.bytes))) for r in back) == sorted(repr((i, (t or "").encode())) for i, t, *_ in rows)


def test_digests(spark, exact, ranks):
    rows = odd_rows()

    def want(i, t):
        ids = exact.encode_ordinary(t or "")
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()

    out = bpe.digests(bpe.encode(frame(spark, rows), ranks), ranks)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(want(i, t)) for i, t, *_ in rows)


def test_bytes_that_are_no_text(spark, exact, ranks):
    df = spark.sql("SELECT 1L doc_id, cast(X'61FF62' AS string) text")
    assert [bytes(r.bytes) for r in bpe.decode(bpe.encode(df, ranks), ranks).collect()] == ["a�b".encode()]


def test_empty_table_and_foreign_ids(spark, ranks):
    assert bpe.digests(bpe.encode(empty(spark), ranks), ranks).count() == 0
    c = bpe.coder(ranks)
    with pytest.raises(ValueError):
        c.decode(np.array([len(c.length)]), np.array([0]))
    nulls = spark.sql("SELECT 5L doc_id, cast(null AS array<int>) ids, cast(null AS array<int>) starts")
    assert [bytes(r.bytes) for r in bpe.decode(nulls, ranks).collect()] == [b""]


def test_chunks_cover_all_rows(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 10)
    assert list(bpe._chunks([4, 4, 4, 30, 0, 1])) == [(0, 2), (2, 3), (3, 4), (4, 6)]
    assert list(bpe._chunks([])) == [] and list(bpe._chunks([0, 0])) == [(0, 2)]
