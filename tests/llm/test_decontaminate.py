import random
from itertools import combinations

import pyarrow as pa
import pytest

from tests.llm.util import corpus, empty, frame, long_text, prose, vocabulary

from skarn.llm.decontaminate import SIMILARITY, WINDOW, Seeds, _words, benchmark_hits, decontaminate, keep_clean


def brute(docs, items):
    """Alignments that hold a window with enough equal words, found by trying all of them."""
    out = set()
    for i, t, *_ in docs:
        d = _words(t or "").tolist()
        for k, b in items:
            b = _words(b or "").tolist()
            w = min(WINDOW, len(b))
            for diag in range(-len(b) + 1, len(d)):
                lo, hi = max(0, -diag), min(len(b), len(d) - diag)
                same = [d[diag + j] == b[j] for j in range(lo, hi)]
                if w and any(sum(same[s : s + w]) >= SIMILARITY * w - 1e-9 for s in range(len(same) - w + 1)):
                    out.add((i, k))
    return out


def test_substituted_passages_are_found(spark):
    r = random.Random(2)
    v = vocabulary(2)
    items = [(k, prose(r, v, r.choice([12, 25, 50]), 99)) for k in range(12)] + [(50, "tiny item here"), (51, ""), (52, None), (None, "null id")]
    docs = [x for x in corpus(9, 30) if x[0] is not None]
    for k, b in items[:12]:
        w = b.split(" ")
        for _ in range(len(w) // 12):
            w[r.randrange(len(w))] = "swapped"
        docs.append((1000 + k, prose(r, v, 80) + " " + " ".join(w).upper() + ", " + prose(r, v, 40), "", ""))
    docs += [(2000, "there is a Tiny item, here.", "", ""), (2001, long_text(), "", "")]
    bench = spark.createDataFrame([(k, b, 1) for k, b in items], "item_id long, text string, hits int")
    got = {(x.doc_id, k) for x in benchmark_hits(frame(spark, docs), bench).collect() for k in x.item_ids}
    want = brute(docs[:-1], [x for x in items if x[0] is not None])
    assert got <= want
    assert {(1000 + k, k) for k in range(12)} | {(2000, 50)} <= got
    assert len(got) >= 0.95 * len(want)
    blocks = decontaminate(frame(spark, docs), bench, block_bytes=400)
    assert {(x.row.doc_id, h.item_id) for x in blocks.collect() for h in x.hits} == got


@pytest.mark.parametrize("n", range(1, 21))
def test_every_pattern_that_the_rule_accepts_is_found(n):
    item = [f"w{j}" for j in range(n)]
    seeds = Seeds([(1, " ".join(item))], WINDOW, SIMILARITY)
    k = n - next(e for e in range(n + 1) if e >= SIMILARITY * n - 1e-9)
    texts = [" ".join(["before", *("other" if j in gone else w for j, w in enumerate(item)), "after"]) for gone in combinations(range(n), k)]
    assert all(len(hits) == 1 for hits in seeds.search(pa.array(texts)))
    if k + 1 < n:
        beyond = [" ".join("other" if j in gone else w for j, w in enumerate(item)) for gone in list(combinations(range(n), k + 1))[:50]]
        assert not any(seeds.search(pa.array(beyond)))


def test_substitutions_equal_brute_force(spark):
    r = random.Random(4)
    v = vocabulary(4)
    items = [(k, prose(r, v, k % 30 + 1, 99)) for k in range(60)]
    docs = []
    for k, b in items:
        for _ in range(3):
            w = b.split(" ")
            n = min(WINDOW, len(w))
            for at in r.sample(range(n), min(n, round(n * (1 - SIMILARITY)) + r.choice([-1, 0, 0, 1])) if n > 4 else 0):
                w[at] = "swapped"
            docs.append((len(docs), f"{prose(r, v, 9)} {' '.join(w)} {prose(r, v, 5)}", "", ""))
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert {(x.doc_id, k) for x in benchmark_hits(frame(spark, docs), bench).collect() for k in x.item_ids} == brute(docs, items)


def test_columns_and_odd_tables(spark):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten")], "item_id long, text string")
    df = frame(spark, [(1, None, None, None), (2, "x One two three four, five six seven eight nine ten y", "", ""), (3, "", "", "")])
    kept = keep_clean(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert keep_clean(df, bench.limit(0)).count() == 3
    assert benchmark_hits(empty(spark), bench).count() == 0


def test_one_hit_for_an_id_with_several_texts(spark):
    a, b = "one two three four five six seven eight nine ten", "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    bench = spark.createDataFrame([(1, a), (1, b), (2, a), (1, a)], "item_id long, text string")
    df = frame(spark, [(7, f"x {a} y {b} z {a}", "", ""), (8, b, "", "")])
    got = {r.doc_id: r for r in benchmark_hits(df, bench).collect()}
    assert got[7].item_ids == [1, 2] and got[7].n_items == 2 and got[7].most_equal == 11 and got[8].item_ids == [1]
    assert [(h.item_id, h.first_word, h.n_equal) for h in got[7].hits] == [(1, 12, 11), (2, 1, 10)]
    blocks = decontaminate(df, bench, block_bytes=60)
    assert {(x.row.doc_id, h.item_id, h.n_equal) for x in blocks.collect() for h in x.hits} == {(7, 1, 11), (7, 2, 10), (8, 1, 11)}
