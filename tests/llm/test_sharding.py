import zlib
from collections import Counter

from tests.llm.util import corpus, empty, frame, long_text

from skarn.llm.sharding import interleave, sharding


def test_every_row_once_and_shards_even(spark):
    rows = corpus(1, 90) + [(500, long_text(), "en", "s1")]
    out = sharding(frame(spark, rows), 7).collect()
    assert len(out) == len(rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    sizes = Counter(r.shard for r in out)
    assert set(sizes) == set(range(7)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r.slot for r in out if r.shard == s) == list(range(n))
    assert {r.law for r in out} == {"rows"} and {r.grown_shard for r in out} == {None}


def test_shards_match_the_mixture(spark):
    rows = [(i, "t", "en", "a" if i % 10 < 6 else "b" if i % 10 < 9 else "c") for i in range(1000)]
    out = interleave(frame(spark, rows), 10).collect()
    for s in range(10):
        mix = Counter(r.source for r in out if r.shard == s)
        assert abs(mix["a"] - 60) <= 2 and abs(mix["b"] - 30) <= 2 and abs(mix["c"] - 10) <= 2


def test_order_is_the_fractional_rank(spark):
    rows = [(i, "t", "en", "ab"[i % 3 == 0]) for i in range(60)]
    out = sorted(interleave(frame(spark, rows), 3).collect(), key=lambda r: r.sequence)
    seen: Counter = Counter()
    n = Counter(r.source for r in out)
    last = 0.0
    for r in out:
        seen[r.source] += 1
        frac = (2 * seen[r.source] - 1) / (2 * n[r.source])
        assert frac >= last
        last = frac


def test_same_result_whatever_the_partitions(spark):
    rows = corpus(2, 30)
    key = lambda d: sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in d.collect())
    assert key(sharding(frame(spark, rows, 1))) == key(sharding(frame(spark, rows, 5)))


def test_few_rows_and_none(spark):
    assert sharding(empty(spark)).count() == 0
    assert sorted(r.slot for r in sharding(frame(spark, [(1, None, None, None), (2, "", "x", "y")])).collect()) == [0, 0]
