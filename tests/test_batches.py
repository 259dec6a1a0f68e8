import random
from collections import Counter, defaultdict

import pytest

from skarn.operators import batching

SCHEMA = "batch_id int, file_id string, package string"


def frame(spark, sizes):
    """Batches of one package each from (batch_id, package, files)."""
    return spark.createDataFrame([(b, f"{p}{b}-{i:04}", p) for b, p, n in sizes for i in range(n)], SCHEMA)


def sizes(df):
    return Counter(r.batch_id for r in df.collect())


def fresh(spark, counts):
    return spark.createDataFrame([(f"new-{p}-{i:04}", p) for p, n in counts for i in range(n)], "file_id string, package string")


def test_twenty_files_for_one_place(spark):
    b = frame(spark, [(1, "p", 249), (2, "p", 240), (7, "q", 250)])
    got = {r.file_id: r.batch_id for r in batching.attach_new(b, fresh(spark, [("p", 20), ("q", 1), ("z", 1)])).collect()}
    assert Counter(got.values()) == {1: 1, 2: 10, None: 11}
    out = batching.attach(b, fresh(spark, [("p", 20), ("q", 1), ("z", 1)]))
    n = sizes(out)
    assert n[1] == n[2] == n[7] == 250 and sorted(n[k] for k in n if k > 7) == [1, 1, 9] and max(n) == 10
    assert out.dtypes == b.dtypes


@pytest.mark.parametrize("seed", range(4))
def test_no_batch_overflows(spark, seed):
    r = random.Random(seed)
    old = [(k, r.choice("pqr"), r.choice([1, 60, 100, 249, 250, 260])) for k in r.sample(range(20_000), r.randint(0, 7))]
    new = [(p, r.choice([0, 3, 260, 700])) for p in "pqrs"]
    b = frame(spark, old)
    out = batching.attach(b, fresh(spark, new)).collect()
    n, before = Counter(x.batch_id for x in out), {k: c for k, _, c in old}
    assert len(out) == len({x.file_id for x in out}) == sum(before.values()) + sum(c for _, c in new)
    assert all(c <= max(250, before.get(k, 0)) and c >= before.get(k, 0) for k, c in n.items())
    packages = defaultdict(set)
    for x in out:
        packages[x.batch_id].add(x.package)
    assert all(len(v) == 1 for v in packages.values())
    for p, c in new:  # a new batch is opened only where there is no room left
        room = sum(max(0, 250 - k) for _, q, k in old if q == p)
        opened = [k for k in n if packages[k] == {p} and k not in before]
        assert len(opened) == -(-max(0, c - room) // 250)


def test_two_small_batches_become_one(spark):
    b = frame(spark, [(1, "p", 10), (2, "p", 10)])
    assert [(r.batch_id, r.into) for r in batching.merge_targets(b).collect()] == [(2, 1)]
    assert sizes(batching.merged(b)) == {1: 20}


@pytest.mark.parametrize("seed", range(4))
def test_merging_keeps_every_file_and_the_limit(spark, seed):
    r = random.Random(seed)
    rows = [(k, r.choice("pq"), r.choice([1, 5, 40, 99, 100, 160, 240, 260])) for k in range(r.randint(1, 14))]
    b = frame(spark, rows)
    to = {x.batch_id: x.into for x in batching.merge_targets(b).collect()}
    assert not set(to) & set(to.values())
    out = batching.merged(b).collect()
    n, before, package = Counter(x.batch_id for x in out), {k: c for k, _, c in rows}, {k: p for k, p, _ in rows}
    assert len(out) == sum(before.values()) == len({x.file_id for x in out})
    assert all(c <= max(250, before[k]) for k, c in n.items()) and all(package[x.batch_id] == x.package for x in out)
    for p in "pq":  # what is left of small batches fits nowhere
        left = sorted(c for k, c in n.items() if package[k] == p)
        small = [c for c in left if c < 100]
        assert len(small) <= 1 and (not small or len(left) == 1 or small[0] + left[1] > 250)


def test_deleted_files(spark):
    b = frame(spark, [(1, "p", 120), (2, "p", 110), (3, "q", 2)])
    gone = spark.createDataFrame([(f"p1-{i:04}",) for i in range(60)] + [("q3-0000",), ("q3-0001",), ("unknown",)], "file_id string")
    assert sizes(batching.without_files(b, gone)) == {2: 170}


def test_the_default_package(spark):
    b = spark.createDataFrame([(1, "a", None), (1, "b", None)], SCHEMA)
    out = batching.attach(b, spark.createDataFrame([("c", None), ("d", "p")], "file_id string, package string"))
    assert {(r.batch_id, r.file_id) for r in out.collect()} == {(1, "a"), (1, "b"), (1, "c"), (2, "d")}
    assert batching.attach(b.limit(0), spark.createDataFrame([("c", None)], "file_id string, package string")).first().batch_id == 0
