import random

import pytest

from tests.llm.util import corpus, empty, frame, long_text, prose, vocabulary, words

from skarn.llm import minhash
from skarn.llm.graph import components
from skarn.llm.minhash import keep_one, near_duplicates

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(t):
    w = words((t or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)])


def brute(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    ids: dict = {}
    for i, (d, *_) in enumerate(rows):
        ids.setdefault(find(i), []).append(d)
    out = []
    for i, (d, *_) in enumerate(rows):
        known = [x for x in ids[find(i)] if x is not None]
        c = d if not sets[i] else min(known) if known else None
        out.append((d, len(sets[i]), c, d is not None and d == c))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rows = corpus(5, 60) + [(700, long_text(6000), "", ""), (701, long_text(6100), "", "")]
    assert got(near_duplicates(frame(spark, rows))) == brute(rows)


def variants(seed, n, edits, length=90):
    r = random.Random(seed)
    v = vocabulary(seed)
    base = prose(r, v, length).split(" ")
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = r.choice(v)
        out.append((i, " ".join(w), "", ""))
    return out


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_large_groups_of_near_copies_and_near_misses(spark, monkeypatch, edits):
    monkeypatch.setattr(minhash, "LARGE", 4)
    rows = variants(edits, 45, edits)
    assert got(near_duplicates(frame(spark, rows))) == brute(rows)


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    rows = [r for r in corpus(6, 45) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())
    df = frame(spark, rows)
    kept = keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(d for d, _, _, k in brute(rows) if k)


def test_keep_one_judges_rows_with_null_and_repeated_ids(spark):
    r = random.Random(12)
    v = vocabulary(12)
    a, b, c, d = (prose(r, v, 30) for _ in range(4))
    rows = [(1, a), (None, a), (None, b), (None, b), (2, a), (2, c), (3, d), (3, d), (4, ""), (None, ""), (None, None)]
    kept = [(x.doc_id, x.text) for x in keep_one(frame(spark, [(i, t, "", "") for i, t in rows])).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (None, b), (2, c), (3, d), (4, ""), (None, ""), (None, None)], key=str)


def test_components(spark):
    r = random.Random(1)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, i) for i in range(501, 560)]
    got_ = {x.u: x.root for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    assert got_ == {x: find(x) for a, b in edges for x in (a, b) if a != b or x in got_}


def test_empty(spark):
    assert near_duplicates(empty(spark)).count() == 0
    assert got(near_duplicates(frame(spark, [(1, None, None, None), (2, "", "", ""), (3, "a", "", ""), (4, "A", "", "")]))) == brute([(1, None), (2, ""), (3, "a"), (4, "A")])


def test_the_largest_id_is_an_id(spark):
    r = random.Random(13)
    v = vocabulary(13)
    a, b, c = (prose(r, v, 30) for _ in range(3))
    top = 2**63 - 1
    rows = [(top, a), (None, a), (None, b), (top, ""), (None, ""), (None, c), (5, c)]
    got_ = sorted(((x.doc_id, x.component_id, x.kept) for x in near_duplicates(frame(spark, [(i, t, "", "") for i, t in rows])).collect()), key=str)
    assert got_ == sorted([(top, top, True), (None, top, False), (None, None, False), (top, top, True), (None, None, False), (None, 5, False), (5, 5, True)], key=str)


@pytest.mark.parametrize("percent", [50, 75, 90])
def test_other_thresholds(spark, percent):
    rows = variants(percent, 30, 3)
    sets = {i: {tuple(words(t.lower())[k : k + 5]) for k in range(len(words(t)) - 4)} for i, t, *_ in rows}
    linked = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    root = {i: i for i in sets}
    for _ in sets:
        for i, j in linked:
            root[i] = root[j] = min(root[i], root[j])
    out = near_duplicates(frame(spark, rows), percent=percent, shared=max(1, int(48 * percent / 100 * 0.6)))
    assert {r.doc_id: r.component_id for r in out.collect()} == root


def test_one_value_in_half_of_all_sketches(spark):
    """A boilerplate passage that many unrelated documents share, beside copies that differ in a word."""
    r = random.Random(14)
    v = vocabulary(14, 3000)
    shared = prose(r, v, 12, 99)
    rows = [(i, prose(r, v, 40, 99) + (" " + shared if i % 2 else ""), "", "") for i in range(240)]
    for i in range(0, 60):
        w = rows[i][1].split(" ")
        w[5] = "changed"
        rows.append((1000 + i, " ".join(w), "", ""))
    assert got(near_duplicates(frame(spark, rows))) == brute(rows)
