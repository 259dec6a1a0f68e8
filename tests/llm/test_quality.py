import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.util import WORD, corpus, empty, frame, long_text, prose, vocabulary

from skarn.llm.classifier import _kappa, classify, keep_good, quality_classifier, site_posteriors, train
from skarn.llm.rules import RULES, fit, quality_rules
from skarn.llm.textops import chunks, plain_hashes

LABELS = "doc_id long, quality int, toxic int, text string"


def base(t):
    t = t or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen: dict = {}
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    cover = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(3)}
    n, rep = len(w), len(cover)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, n < 50 or 100 * rep > 50 * n


def test_base_statistics(spark):
    rows = corpus(10, 45) + [(900, long_text(), "", ""), (901, "# * $\n# * $\n\n\n x|y<z>&%", "", "")]
    out = quality_rules(frame(spark, rows)).collect()
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out), key=str)
    assert got == sorted(((i, *base(t)) for i, t, *_ in rows), key=str)
    assert all(not (r.base_failed and r.kept) for r in out)
    assert quality_rules(empty(spark)).count() == 0


def test_em_recovers_accuracies():
    r = np.random.default_rng(0)
    n, m = 20_000, len(RULES)
    good = r.random(n) < 0.85
    vote = np.where(r.random((n, m)) < np.where(good, 0.002, 0.5)[:, None], -1, 1)
    vote[r.random((n, m)) < 0.2] = 0
    pats, inverse, counts = np.unique(vote, axis=0, return_inverse=True, return_counts=True)
    keep = fit(pats, counts)[inverse.ravel()] >= 0.5
    assert (keep == good).mean() > 0.97
    assert len(fit(np.zeros((0, m), int), np.zeros(0))) == 0


def documents(seed, n):
    r = random.Random(seed)
    v = vocabulary(1)
    bad = ["vilelout", "grubnik", "stenchor"]
    docs, labels = [], []
    for i in range(n):
        t = prose(r, v, r.randint(60, 150))
        kind = r.random()
        q, tox = 1, 0
        if kind < 0.15:
            t, q = " ".join(f"{w.upper()}!!" for w in t.split()), 0
        elif kind < 0.35:
            w = t.split(" ")
            for _ in range(2):
                w[r.randrange(len(w))] = r.choice(bad) + r.choice(["", ".", ","])
            t, tox = " ".join(w), 1
        docs.append((i, t, "en", r.choice(["s1", "s2", None])))
        labels.append((i, q, tox))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = documents(3, 900)
    lab = spark.createDataFrame([(*x, "clash") for x in labels if x[0] % 2], LABELS)
    out = {r.doc_id: r.kept for r in quality_classifier(frame(spark, docs), lab).collect()}
    held = [(out[i], q == 1 and t == 0) for i, q, t in labels if i % 2 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert sum(a for a, b in held if b) / sum(b for _, b in held) > 0.98


def test_sites_shrink(spark):
    assert _kappa({"groups": 1, "total": 5, "between": 0, "squares": 25, "rate": 1}) == 100.0
    docs, labels = documents(4, 300)
    df = frame(spark, docs)
    model = train(df, spark.createDataFrame([(*x, "") for x in labels], LABELS))
    sites = {(r.row.source, r.row.lang): (r.host_p, r.path_p) for r in classify(df, model).collect()}
    assert len(sites) == 3 and all(0 < h < 1 and 0 < p < 1 for h, p in sites.values())


def test_odd_tables(spark):
    none = spark.createDataFrame([], LABELS)
    rows = corpus(11, 15)
    out = quality_classifier(frame(spark, rows), none).collect()
    assert len(out) == len(rows) and all(r.kept for r in out)
    one = spark.createDataFrame([(0, 1, 0, None), (None, 0, 1, None), (1, None, 1, None)], LABELS)
    kept = keep_good(frame(spark, rows), one)
    assert kept.columns == frame(spark, rows).columns and kept.count() == len(rows)
    assert quality_classifier(empty(spark), one).count() == 0


def test_posteriors_by_direct_em_over_rows(spark):
    rows = corpus(21, 45) + [(700, "word " * 3000, "", ""), (701, " ".join(f"v{i % 700}" for i in range(5000)), "", "")]
    out = quality_rules(frame(spark, rows)).collect()
    names = [f"vote_{k}" for k in RULES]
    v = [[r[n] for n in names] for r in out]
    post = [0.98 if -1 not in x else 0.1 for x in v]
    for _ in range(200):
        p = (sum(post) + 1000 * 0.85) / (len(v) + 1000)
        new = [math.log(p / (1 - p))] * len(v)
        for j in range(len(names)):
            a = min((sum(w for w, x in zip(post, v) if x[j] == -1) + 0.002 * 1000) / (sum(w for w, x in zip(post, v) if x[j]) + 1000), 0.02)
            b = max((sum(1 - w for w, x in zip(post, v) if x[j] == -1) + 0.3 * 1000) / (sum(1 - w for w, x in zip(post, v) if x[j]) + 1000), a)
            new = [y + (math.log(a / b) if x[j] == -1 else math.log((1 - a) / (1 - b)) if x[j] == 1 else 0) for y, x in zip(new, v)]
        new = [1 / (1 + math.exp(-y)) for y in new]
        done, post = max(abs(x - y) for x, y in zip(new, post)) < 1e-9, new
        if done:
            break
    assert all(abs(r.posterior - q) < 2e-6 and r.kept == (not r.base_failed and q >= 0.5) for r, q in zip(out, post))
    by = {r.doc_id: r for r in out}
    assert by[700].vote_variety == -1 and by[701].vote_variety == 1  # however long


def test_punctuation_at_edges_goes_however_much():
    c = next(chunks(pa.array(["word word...... (\"word\") ''word!!!!!!! ....... . x"])))
    h = plain_hashes(c, *c.words())
    assert len(set(h[:4].tolist())) == 1 and len(set(h.tolist())) == 3


def test_site_posteriors_by_hand(spark):
    ev = spark.createDataFrame([("a", "x", 1.0)] * 3 + [("a", "y", 0.0)] * 5 + [("b", "x", 0.0)] * 20 + [("b", "z", 0.5)], "host string, path string, p double")
    sites, rate = site_posteriors(ev)
    n, s = {("a", "x"): 3, ("a", "y"): 5, ("b", "x"): 20, ("b", "z"): 1}, {("a", "x"): 3.0, ("a", "y"): 0.0, ("b", "x"): 0.0, ("b", "z"): 0.5}
    assert abs(rate - 3.5 / 29) < 1e-12

    def kappa(groups):
        total = sum(m for m, _, _ in groups)
        p = sum(m * q for m, _, q in groups) / total
        size = (total - sum(m * m for m, _, _ in groups) / total) / (len(groups) - 1)
        spread = (sum(m * (x / m - q) ** 2 for m, x, q in groups) / (len(groups) - 1) - p * (1 - p)) / size
        return min(max(p * (1 - p) / spread - 1, 5.0), 10_000.0) if spread > 1e-9 else 10_000.0

    hosts = {h: (sum(n[k] for k in n if k[0] == h), sum(s[k] for k in s if k[0] == h)) for h in "ab"}
    kh = kappa([(m, x, rate) for m, x in hosts.values()])
    hp = {h: (x + kh * rate) / (m + kh) for h, (m, x) in hosts.items()}
    kp = kappa([(n[k], s[k], hp[k[0]]) for k in n])
    for r in sites.collect():
        k = (r.host, r.path)
        assert abs(r.host_p - hp[r.host]) < 1e-9 and abs(r.path_p - (s[k] + kp * hp[r.host]) / (n[k] + kp)) < 1e-9


@pytest.mark.parametrize("counts", [(100, 800, 800), (1000, 9000, 9000), (10**6, 10**6, 10**6), (10**4, 9 * 10**4, 0)])
def test_the_majority_is_not_called_good_for_being_one(counts):
    votes = np.ones((3, len(RULES)), int)
    votes[1:, 5], votes[2, 6] = -1, -1
    post = fit(votes, np.array(counts))
    assert post[0] > 0.5 > max(post[1], post[2])


def test_nine_bad_texts_in_ten(spark):
    r = random.Random(8)
    vocab = vocabulary(8)
    rows = []
    for i in range(850):
        t = prose(r, vocab, 120) + "."
        if i >= 50:
            t = t.upper()
            if i % 2:
                w = t.split(" ")
                t = " ".join(x + "!!" if k % 2 else x for k, x in enumerate(w))
        rows.append((i, t, "en", "s"))
    kept = {x.doc_id for x in quality_rules(frame(spark, rows)).where("kept").collect()}
    assert kept == set(range(50))


def test_verdicts_by_brute_force(spark):
    """Every row's evidence, its site's posteriors by hand, and their combination; a null host or path is a site, a very long text one document."""
    docs, labels = documents(5, 160)
    docs += [(900, None, None, None), (901, "", "en", "s1"), (902, long_text(30_000), "de", "s1"), docs[3], docs[3], (None, docs[5][1], None, "s2")]
    model = train(frame(spark, docs), spark.createDataFrame([(*x, "") for x in labels], LABELS))
    low, toxic = (x.tolist() for x in model.scores(pa.array([t for _, t, *_ in docs], pa.string())))
    reject = [1 - (1 - a) * (1 - b) for a, b in zip(low, toxic)]
    site = [(s, lang) for _, _, lang, s in docs]
    rate = min(max(sum(reject) / len(reject), 1e-4), 1 - 1e-4)

    def shrunk(groups, parents):
        """Posterior of each group's rate: its own evidence and kappa times its parent's."""
        n, s = {k: len(v) for k, v in groups.items()}, {k: sum(v) for k, v in groups.items()}
        total = sum(n.values())
        kappa = 100.0
        if len(groups) > 1:
            mean = min(max(sum(n[k] * parents[k] for k in groups) / total, 1e-4), 1 - 1e-4)
            size = (total - sum(v * v for v in n.values()) / total) / (len(groups) - 1)
            spread = (sum(n[k] * (s[k] / n[k] - parents[k]) ** 2 for k in groups) / (len(groups) - 1) - mean * (1 - mean)) / max(size, 1e-9)
            kappa = min(max(mean * (1 - mean) / spread - 1, 5.0), 10_000.0) if spread > 1e-9 else 10_000.0
        return {k: (s[k] + kappa * parents[k]) / (n[k] + kappa) for k in groups}

    hosts, paths = {}, {}
    for (h, q), e in zip(site, reject):
        hosts.setdefault(h, []).append(e)
        paths.setdefault((h, q), []).append(e)
    host_p = shrunk(hosts, dict.fromkeys(hosts, rate))
    path_p = shrunk(paths, {k: host_p[k[0]] for k in paths})
    odds = lambda x: math.log(x / (1 - x))
    want = []
    for (i, *_), k, e in zip(docs, site, reject):
        post = 1 / (1 + math.exp(-(odds(min(max(e, 1e-9), 1 - 1e-9)) + odds(path_p[k]) - odds(rate))))
        want.append((i, round(post, 4), post < 0.5))
    out = quality_classifier(frame(spark, docs), spark.createDataFrame([(*x, "") for x in labels], LABELS)).collect()
    assert sorted(((r.doc_id, round(r.p_reject, 4), r.kept) for r in out), key=str) == sorted(want, key=str)
