"""Centroid clustering by partial-distance search (operator 12).

Vectors become integers, floor(1024 * x) of each component, and all that follows is exact integer work: squared
distances, sums, floored means.  A vector's distance to a centroid is added up over the dimensions of highest
variance first; the search leaves a centroid once the sum is strictly above the best full distance so far, so
ties still go to the smaller number.  What survives has all dimensions added.

Every round is one pass: each task assigns its vectors and gives one row of sums a cluster, which Spark adds.
Nothing else reaches the driver but k centroids.  A round that changes nothing ends the rounds.

Kept are vectors with exactly ``dims`` components, none null, NaN or infinite.  Rows without an id are clustered
like others but start no centroid; where no row has an id there are no centroids, and cluster, distance and the
rest are null.  Repeated rows count each; of rows with one id the smaller vector comes first as a start.  With
fewer than k vectors there are fewer centroids.  Components beyond 2**27 are reckoned in integers of any size;
distances and inertias that do not fit a long are null.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.session import cut

DIMS, SCALE, CLUSTERS, ROUNDS, SEED = 64, 1024, 8, 10, 3
#: Dimensions that are added between two looks at the best distance.
STRIDE = 8
#: Components up to this fit 64-bit distances: 64 * (2 * 2**27) ** 2 = 2**62.
NARROW = 1 << 27
#: Sums travel in limbs of so many bits, so that any number of them can be added as longs.
LIMB = 30
LONG = (1 << 63) - 1


def usable(vector: Column, dims: int = DIMS) -> Column:
    """Whether a vector has dims components, all of them finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & (F.size(vector) == dims) & F.forall(vector, finite)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(SCALE * x) of finite doubles: int64 where narrow, else Python's integers."""
    if not values.size or np.abs(values).max() <= NARROW / SCALE - 1:
        return np.floor(values * SCALE).astype(np.int64)
    exact = lambda x: math.floor(x * SCALE) if abs(x) < 1 << 53 else int(x) * SCALE
    return np.array([exact(x) for x in values.ravel().tolist()], object).reshape(values.shape)


def _centroids(rows: list[list[int]]) -> np.ndarray:
    narrow = all(abs(v) <= NARROW for row in rows for v in row)
    return np.array(rows, np.int64 if narrow else object)


def nearest(x: np.ndarray, centroids: np.ndarray, order: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The number of and squared distance to each row's nearest centroid (the smaller number of equally near ones)."""
    if object in (x.dtype, centroids.dtype):
        x, centroids = x.astype(object), centroids.astype(object)
    x, centroids = x[:, order], centroids[:, order]

    def added(rows: np.ndarray, to: np.ndarray, a: int, b: int) -> np.ndarray:
        d = rows[:, a:b] - to[..., a:b]
        return (d * d).sum(axis=1)

    part = np.stack([added(x, c, 0, STRIDE) for c in centroids], axis=1)
    first = np.array(part.argmin(axis=1), np.int64)  # a good guess, so that the others are left early
    who = first.copy()
    best = part[np.arange(len(x)), first] + added(x, centroids[first], STRIDE, x.shape[1])
    for j, c in enumerate(centroids):
        alive = np.flatnonzero((first != j) & (part[:, j] <= best).astype(bool))
        so_far = part[alive, j]
        for a in range(STRIDE, x.shape[1], STRIDE):
            so_far = so_far + added(x[alive], c, a, a + STRIDE)
            stays = (so_far <= best[alive]).astype(bool)
            alive, so_far = alive[stays], so_far[stays]
        better = (so_far < best[alive]).astype(bool) | ((so_far == best[alive]).astype(bool) & (j < who[alive]))
        who[alive[better]], best[alive[better]] = j, so_far[better]
    return who, best


def limbs(values: list[int]) -> Iterator[list[int]]:
    """The values' digits in base 2**LIMB, the lowest first, each with its value's sign."""
    signs, rest = [-1 if v < 0 else 1 for v in values], [abs(v) for v in values]
    while True:
        yield [s * (v & ((1 << LIMB) - 1)) for s, v in zip(signs, rest)]
        rest = [v >> LIMB for v in rest]
        if not any(rest):
            return


def _matrix(vectors: pa.Array, dims: int) -> np.ndarray:
    return integers(vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), dims))


def _sums(kept: DataFrame, centroids: np.ndarray, order: list[int], dims: int) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has vectors: their number and the sums of their components."""
    schema = pa.schema([("cluster", pa.int32()), ("limb", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.int64()))])

    def run(batches):
        count, total = [0] * len(centroids), [[0] * dims for _ in centroids]
        for b in batches:
            x = _matrix(b.column(0), dims)
            who, _ = nearest(x, centroids, order)
            for j in np.unique(who).tolist():
                of = x[who == j]
                count[j] += len(of)
                total[j] = [a + v for a, v in zip(total[j], of.sum(axis=0).tolist())]
        rows = [(j, k, 0 if k else count[j], digits) for j in range(len(count)) if count[j] for k, digits in enumerate(limbs(total[j]))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)

    parts = kept.select("vector").mapInArrow(run, "cluster int, limb int, n long, s array<long>")
    added = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("s")[i]) for i in range(dims))).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in added.collect():  # a few rows a cluster
        n, s = out.get(r.cluster, (0, [0] * dims))
        out[r.cluster] = (n + r.n, [a + (v << LIMB * r.limb) for a, v in zip(s, r.s)])
    return out


def starts(kept: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors with the smallest hashes of seed and id, as integers."""
    named = kept.where("vec_id IS NOT NULL").withColumn("hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    return [integers(np.array(r.vector, float)).tolist() for r in named.orderBy("hash", "vector").limit(clusters).select("vector").collect()]


def by_variance(kept: DataFrame, dims: int) -> list[int]:
    """Dimensions, those of highest variance first.  Decides how soon a search ends, never how."""
    row = kept.agg(F.array(*(F.var_pop(F.col("vector")[i]) for i in range(dims))).alias("v")).first()
    return sorted(range(dims), key=lambda i: (-(row.v[i] if row.v[i] is not None and math.isfinite(row.v[i]) else math.inf), i))


def cluster(table: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = table.sparkSession
    src = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    kept = src.where(usable(F.col("vector"), dims))
    rows = starts(kept, clusters, seed)
    if not rows:
        nothing = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
        return kept.select("vec_id", *(F.lit(None).cast(t).alias(k) for k, t in nothing.items()))
    order = by_variance(kept, dims)
    for _ in range(rounds):
        sums = _sums(kept, _centroids(rows), order, dims)
        new = [[v // sums[j][0] for v in sums[j][1]] if j in sums else c for j, c in enumerate(rows)]
        if new == rows:
            break
        rows = new
    final = _centroids(rows)
    schema = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64())])

    def assign(batches):
        for b in batches:
            who, far = nearest(_matrix(b.column(1), dims), final, order)
            fits = pa.array(far) if far.dtype != object else pa.array([v if v <= LONG else None for v in far.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(who.astype(np.int32)), fits], schema=schema)

    assigned = cut(kept.select("vec_id", "vector").mapInArrow(assign, "vec_id long, cluster int, distance long"))
    per_cluster = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s"), F.count(F.when(F.col("distance").isNull(), 1)).alias("unknown")).collect()
    inertia = {r.cluster: None if r.unknown else int(r.s) for r in per_cluster}
    total = None if None in inertia.values() else sum(inertia.values())
    fit = lambda v: v if v is not None and v <= LONG else None
    facts = [(j, fit(v), fit(total), hashlib.sha256(",".join(map(str, rows[j])).encode()).hexdigest()) for j, v in inertia.items()]
    small = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def oracle(clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED, dims: int = DIMS) -> str:
    """The same by whole distances, one pair of tables a round."""
    parts = [
        f"""kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, [CAST(floor({SCALE} * CAST(e AS DOUBLE)) AS BIGINT) FOR e IN embedding] AS v FROM embeddings
            WHERE len(embedding) = {dims} AND len([e FOR e IN embedding IF e IS NOT NULL AND isfinite(e)]) = {dims})""",
        f"x AS MATERIALIZED (SELECT rid, i, v[i] AS x FROM kept, range(1, {dims + 1}) t(i))",
        f"""c0 AS MATERIALIZED (SELECT k, i, x FROM (SELECT rid, row_number() OVER (ORDER BY sha256('{seed}:' || CAST(vec_id AS VARCHAR)), v) - 1 AS k
            FROM kept WHERE vec_id IS NOT NULL QUALIFY k < {clusters}) JOIN x USING (rid))""",
    ]
    for n in range(rounds + 1):
        parts.append(
            f"""a{n} AS MATERIALIZED (SELECT rid, k, d FROM (SELECT rid, k, sum((x.x - c.x) * (x.x - c.x)) AS d FROM x JOIN c{n} c USING (i) GROUP BY rid, k)
            QUALIFY row_number() OVER (PARTITION BY rid ORDER BY d, k) = 1)"""
        )
        if n < rounds:
            parts.append(
                f"""c{n + 1} AS MATERIALIZED (SELECT k, i, coalesce((s - ((s % n) + n) % n) // n, c.x) AS x
                FROM c{n} c LEFT JOIN (SELECT k, i, sum(x) AS s, count(*) AS n FROM a{n} JOIN x USING (rid) GROUP BY k, i) USING (k, i))"""
            )
    return (
        "WITH "
        + ",\n".join(parts)
        + f""" SELECT vec_id, CAST(k AS INTEGER) AS "cluster", CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
        CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
        FROM a{rounds} JOIN kept USING (rid) JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k) USING (k)"""
    )


ORACLE = oracle()
