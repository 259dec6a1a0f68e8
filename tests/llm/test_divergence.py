import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.util import corpus, empty, frame, long_text

from skarn.llm import divergence as dv

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut_up(t):
    return [x.translate(LOWER) for x in TERM.findall(t)]


def brute(rows, least=30, top=50):
    """The contract with a count for every group and kept term."""
    n, d, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, t, lang, source in rows:
        lang, source = lang or "", source or ""
        w = cut_up(t or "")
        groups[lang].add(source)
        n[lang, source].update(w)
        d[lang].update(set(w))
    out = []
    for lang, sources in groups.items():
        kept = [t for t, k in d[lang].items() if k >= least]
        size = len(kept)

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * size) for t in kept}

        p = {s: shares(n[lang, s]) for s in sources}
        q = shares(sum((n[lang, s] for s in sources), Counter()))
        for s in sources:
            pair = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in sources - {s})
            term = sorted((-(p[s][t] - q[t]), t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -f, k + 1) for part, found in (("pair", pair), ("term", term)) for k, (f, i) in enumerate(found)]
    return sorted(map(repr, out))


def got(df):
    return sorted(repr(tuple(r)) for r in df.collect())


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("aAzZ@[`{é\x7f\x80\x85  \0'1", max_size=60)))
def test_terms(text):
    text = text.encode("utf-8", "replace").decode()
    assert [t.decode() for t in dv.terms(text.encode())] == cut_up(text)


def test_terms_of_bytes_that_are_no_text():
    assert [t.decode() for t in dv.terms(b"a\xffb C")] == ["a�b", "c"]


def many(seed, sources, docs, vocabulary=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdé") for _ in range(r.randint(1, 4))) for _ in range(vocabulary)]
    skew = {s: [r.random() ** 4 for _ in words] for s in sources}
    rows = []
    for i in range(docs):
        s, lang = r.choice(sources), r.choice(["en", "en", "de", None])
        rows.append((i, " ".join(r.choices(words, skew[s], k=r.randint(0, 30))), lang, s))
    return rows


def test_equals_brute_force(spark):
    rows = many(1, ["s1", "s1", "s1", "s2", "s3", None, "é", "z"], 300) + corpus(11, 45) + [(i, None, "xx", f"q{i % 3}") for i in range(4)] + [(9, long_text(20_000), "en", "s9")]
    out = dv.divergence(frame(spark, rows), min_docs=8, top=7)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert got(out) == brute(rows, 8, 7)


def test_blocks_of_sources(spark):
    rows = many(2, [f"s{i}" for i in range(23)], 500)
    assert got(dv.divergence(frame(spark, rows), min_docs=5, top=4, shards=3, block=4)) == brute(rows, 5, 4)


def test_no_kept_terms_and_one_source(spark):
    rows = [(1, "a b", "en", "x"), (2, "c", "en", "y"), (3, "", "en", "z"), (4, "word", "de", "x")]
    assert got(dv.divergence(frame(spark, rows))) == brute(rows)
    assert {r.value for r in dv.divergence(frame(spark, rows)).collect()} == {0}
    assert dv.divergence(empty(spark)).count() == 0


def test_counts_given_out_early(spark, monkeypatch):
    rows = many(3, ["a", "b", "c"], 120)
    monkeypatch.setattr(dv, "HELD", 5)
    assert got(dv.divergence(frame(spark, rows), min_docs=5)) == brute(rows, 5)


def test_counts_beyond_64_bits(spark):
    """A share of a count of 10**11 needs a product of 10**20."""
    counts = spark.createDataFrame([("en", s, t, n, 40) for s, t, n in (("a", "x", 10**11), ("a", "y", 5), ("b", "x", 7))], "lang string, source string, term string, n long, d long")
    kept = dv.kept_counts(counts, 2).collect()
    assert {(r.source, r.term, r.n, r.total) for r in kept} == {("a", "x", 10**11, 10**11 + 7), ("a", "y", 5, 5), ("b", "x", 7, 10**11 + 7)}
    facts = [("en", "a", "x", 10**11, 10**11 + 7, 10**11 + 5, 10**11 + 12, 2, 1, 0, 0, 0)]
    rows = spark.createDataFrame(facts, "lang string, source string, term string, n long, total long, group_total long, lang_total long, vocabulary long, z long, block long, low long, high long")
    assert [r.x for r in dv.shard_sums(rows, 1).where("kind = 'level'").collect()] == [1 + 10**9 * (10**11 + 5) // (10**11 + 15)]


def test_the_sql_is_the_contract(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rows = con.execute("SELECT doc_id, text, lang, source FROM documents").fetchall()
    want = brute(rows)
    assert want == sorted(repr(tuple(r)) for r in con.execute(dv.ORACLE).fetchall())
    assert want == got(dv.divergence(spark.read.parquet(f"{sf}/documents.parquet")))


