import math

import duckdb
import pytest

import __spark_entry__ as entry
from skarn.plans import workload

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


def same(spark, sf, name, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    cols = sorted(df.columns)
    got = sorted(repr([value(r[c]) for c in cols]) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    want = sorted(repr([value(r[names.index(c)]) for c in cols]) for r in res.fetchall())
    assert got == want, name


@pytest.mark.parametrize("name", sorted(workload.ORACLES))
def test_query_equals_its_oracle(spark, sf, name):
    same(spark, sf, name, workload.QUERIES[name], workload.ORACLES[name])


def test_pack_batches_follows_the_plan(spark, sf):
    from collections import defaultdict

    from skarn.operators.batching import pack

    rows = defaultdict(list)
    for r in workload.pack_batches(spark, sf).collect():
        rows[r.project].append(r)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("source", "lang", "doc_id").collect()
    for project, got in rows.items():
        sizes: dict = {}
        for d in sorted((d for d in docs if d.source == project), key=lambda d: d.doc_id):
            sizes[d.lang] = sizes.get(d.lang, 0) + 1
        want = {(p, f, n, b) for b, batch in enumerate(pack(sizes.items())) for p, f, n in batch}
        assert {(r.package, r.first, r.files, r.batch) for r in got} == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "pos", "name"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
