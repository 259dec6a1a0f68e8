import hashlib
import math
import random
from fractions import Fraction

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from skarn.llm import clusters

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, cluster string, hash int, n int"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, "v", "c", 0, 0) for i, v in rows], SCHEMA).repartition(parts)


def whole(x):
    return math.floor(Fraction(x) * 1024)


def brute(rows, k=8, rounds=10):
    """The contract, step by step, in Python's integers."""
    f32 = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None else None) for i, v in rows]
    kept = [(i, v) for i, v in f32 if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    cents = [[whole(x) for x in v] for _, v in named[:k]]
    vecs = [[whole(x) for x in v] for _, v in kept]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cents))
    for _ in range(rounds):
        to = [near(v)[1] for v in vecs]
        new = []
        for j, c in enumerate(cents):
            of = [v for v, t in zip(vecs, to) if t == j]
            new.append([sum(col) // len(of) for col in zip(*of)] if of else c)
        cents = new
    last = [near(v) for v in vecs]
    per = {j: sum(d for d, t in last if t == j) for _, j in last}
    out = []
    for (i, _), (d, j) in zip(kept, last):
        fit = lambda v: v if v < 2**63 else None
        out.append((i, j, fit(d), fit(per[j]) if all(x < 2**63 for x, t in last if t == j) else None, fit(sum(per.values())) if all(x < 2**63 for x, _ in last) else None, hashlib.sha256(",".join(map(str, cents[j])).encode()).hexdigest()))
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


def vectors(seed, n, spread=0.2):
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    return [(i, [c + r.gauss(0, spread) for c in r.choice(centers)]) for i in range(n)]


def odd(rows):
    some = rows[0][1]
    return rows + [(None, some), (None, None), (900, None), (901, some[:63]), (902, some + [0.0]), (903, [None, *some[1:]]), (904, [float("nan"), *some[1:]]), (905, [float("inf"), *some[1:]]), (906, []), rows[3], rows[3], (907, [0.0] * 64), (908, [-0.0] * 64), (909, [-1e-20] * 64)]


def test_equals_brute_force(spark):
    rows = odd(vectors(1, 120))
    out = clusters.cluster(frame(spark, rows))
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert got(out) == brute(rows)


def test_ties_go_to_the_smaller_number(spark):
    rows = [(i, [float((i >> b) & 1) for b in range(3)] * 21 + [0.5]) for i in range(24)]  # eight corners of a cube, three times
    assert got(clusters.cluster(frame(spark, rows))) == brute(rows)
    same = [(i, [0.25] * 64) for i in range(20)]
    assert {r.cluster for r in clusters.cluster(frame(spark, same)).collect()} == {0}
    assert got(clusters.cluster(frame(spark, same))) == brute(same)


def test_few_vectors_and_none(spark):
    few = vectors(2, 3)
    assert got(clusters.cluster(frame(spark, few))) == brute(few)
    assert clusters.cluster(frame(spark, few).limit(0)).count() == 0
    nameless = clusters.cluster(frame(spark, [(None, [1.0] * 64)])).collect()
    assert [tuple(r) for r in nameless] == [(None,) * 6]


def test_values_beyond_64_bits(spark):
    r = random.Random(4)
    rows = vectors(3, 30) + [(100 + i, [r.choice([-1, 1]) * 10.0 ** r.randint(0, 38) * 3 for _ in range(64)]) for i in range(12)] + [(200, [3e38] * 64), (201, [-3e38] * 64), (202, [131071.5] * 64), (203, [131072.5] * 64)]
    assert got(clusters.cluster(frame(spark, rows))) == brute(rows)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 40), st.integers(1, 6), st.integers(0, 2**31), st.sampled_from([2, 50, 1 << 27]))
def test_search_equals_whole_distances(n, k, seed, size):
    r = np.random.default_rng(seed)
    x, c = r.integers(-size, size, (n, 64)), r.integers(-size, size, (k, 64))
    if k > 2:
        c[2] = c[0]
    full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    who, far = clusters.nearest(x, c, r.permutation(64).tolist())
    assert who.tolist() == full.argmin(axis=1).tolist() and far.tolist() == full.min(axis=1).tolist()
    who, far = clusters.nearest(x.astype(object), c, list(range(64)))
    assert who.tolist() == full.argmin(axis=1).tolist() and far.tolist() == full.min(axis=1).tolist()


@given(st.lists(st.integers(-(10**60), 10**60), min_size=1, max_size=5))
def test_limbs_add_up(values):
    assert [sum(d << clusters.LIMB * k for k, d in enumerate(x)) for x in zip(*clusters.limbs(values))] == values


def test_the_sql_is_the_contract(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    assert sorted(repr(tuple(r)) for r in con.execute(clusters.ORACLE).fetchall()) == brute(rows) == got(clusters.cluster(spark.read.parquet(f"{sf}/embeddings.parquet")))


def test_dimensions_by_variance(spark):
    rows = [(i, [0.0] * 5 + [float(i)] + [0.1 * i] * 2 + [1.0] * 56) for i in range(9)]
    src = frame(spark, rows).selectExpr("vec_id", "cast(embedding as array<double>) vector")
    assert clusters.by_variance(src, 64)[:3] == [5, 6, 7]


def test_clashing_types(spark):
    rows = vectors(9, 20)
    assert got(clusters.cluster(frame(spark, rows).selectExpr("cast(vec_id as int) vec_id", "embedding", "label vector"))) == brute(rows)
