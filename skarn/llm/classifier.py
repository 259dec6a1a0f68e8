"""Quality classifier by hierarchical empirical Bayes (operator 9).

1. A document classifier is fitted on at most ``max_labelled`` labelled documents (those with the smallest
   hashed ids): surface statistics of the whole text, plus a lexicon of words whose shrunken toxicity rate is
   high.  Two logistic heads, low quality and toxic, are fitted on the sample, each half of it with the
   lexicon of the other half.
2. Every document is scored.  Scores are summed per host and per host and path by grouped aggregation with
   map-side partial sums, over all documents.
3. Site posteriors shrink toward the global rate: a host's mean toward the corpus, a path's mean toward its
   host, each with a strength estimated from the spread between groups (method of moments), so that sparse
   sites stay near their parent.
4. A document's log-odds move by its path's log-odds relative to the corpus; it is kept when the posterior
   probability of rejection is under 0.5.

Null texts count as empty; null hosts and paths form sites of their own; repeated rows and null ids are
scored like others.  With no labels, or one class only, that head falls back to the prior rate (0.05), and
documents are kept.  Lexicon words of equal score rank by the number of documents that hold them, then by hash.
Input columns are returned unchanged, whatever their names, with one struct beside them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.features import chunk_stats
from skarn.llm.session import Scratch, cut
from skarn.llm.skew import salted_join
from skarn.llm.textops import Chunk, chunks, plain_hashes

MAX_LABELLED = 20_000
LEXICON = 512
#: Sites up to this number are broadcast (some 15 MB).
MAX_BROADCAST = 200_000
EVIDENCE = "low double, toxic double"


def _dense(s: dict[str, np.ndarray]) -> np.ndarray:
    w = np.maximum(s["n_words"], 1)
    letters, chars, lines = np.maximum(s["n_letters"], 1), np.maximum(s["word_chars"], 1), np.maximum(s["n_lines"], 1)
    ratios = [s["n_symbols"] / w, s["n_bang"] / w, s["n_upper"] / letters, s["n_dup_lines"] / lines, s["n_repeat_words"] / w, s["n_distinct"] / w, s["n_pipe"] / w, s["n_letters"] / chars, s["n_digits"] / chars]
    return np.column_stack([np.log1p(s["n_words"]), np.minimum(s["word_chars"] / w, 20) / 10, *(np.minimum(r, 2.0) for r in ratios), s["n_words"] < 20])


def _features(texts: pa.Array, lexicon: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Dense features, then lexicon evidence: distinct hits, their summed and largest weight, hits per word."""
    parts = []
    for c in chunks(texts, lower=False):
        start, end = c.words()
        doc = c.doc_of(start)
        tox = np.zeros((c.n, 4))
        if len(lexicon) and len(start):
            h = _plain(c, start, end)
            at = np.minimum(np.searchsorted(lexicon, h), len(lexicon) - 1)
            hit = lexicon[at] == h
            d, k = np.unique(np.column_stack([doc[hit], at[hit]]), axis=0).T if hit.any() else (np.zeros(0, int), np.zeros(0, int))
            np.add.at(tox[:, 0], d, 1)
            np.add.at(tox[:, 1], d, weight[k])
            np.maximum.at(tox[:, 2], d, weight[k])
            tox[:, 0] = np.minimum(tox[:, 0], 3)
            tox[:, 1] = np.minimum(tox[:, 1], 10)
            tox[:, 3] = np.minimum(np.bincount(doc[hit], minlength=c.n) / np.maximum(np.bincount(doc, minlength=c.n), 1), 0.2) * 5
        parts.append(np.column_stack([_dense(chunk_stats(c)), tox]))
    return np.concatenate(parts) if parts else np.zeros((0, 16))


def _plain(c: Chunk, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return plain_hashes(Chunk(c.first, c.data, c.off, lower=True), start, end)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, scales, weights with the intercept last) by Newton steps; a single class gives a constant."""
    n, m = x.shape
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-6) if n else (np.zeros(m), np.ones(m))
    w = np.zeros(m + 1)
    if n == 0 or y.min() == y.max():
        w[-1] = np.log(0.05 / 0.95)
        return mean, scale, w
    z = np.column_stack([(x - mean) / scale, np.ones(n)])
    penalty = np.full(m + 1, ridge)
    penalty[-1] = 1e-3
    w[-1] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        g = z.T @ (y - p) - penalty * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), g)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, w


def _apply(model, x: np.ndarray) -> np.ndarray:
    mean, scale, w = model
    return 1 / (1 + np.exp(-np.clip(np.clip((x - mean) / scale, -8, 8) @ w[:-1] + w[-1], -30, 30)))


class Model:
    """Lexicon and the two heads; a few tens of kilobytes."""

    def __init__(self, lexicon, weight, low, toxic):
        self.lexicon, self.weight, self.low, self.toxic = lexicon, weight, low, toxic

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x = _features(texts, self.lexicon, self.weight)
        return _apply(self.low, x), _apply(self.toxic, x)

    def column(self, text: Column) -> Column:
        """struct(low, toxic) of each text."""
        model = self

        def score(texts: pa.Array) -> pa.Array:
            low, toxic = model.scores(texts)
            return pa.StructArray.from_arrays([pa.array(low), pa.array(toxic)], ["low", "toxic"])

        return F.arrow_udf(score, EVIDENCE)(text)


def train(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, lexicon_size: int = LEXICON) -> Model:
    """Fits the document classifier on a sample of at most max_labelled labelled documents."""
    sample = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("q"), F.col("toxic").cast("int").alias("t")).where("id is not null and q is not null and t is not null").dropDuplicates(["id"]).orderBy(F.xxhash64("id"), "id").limit(max_labelled)
    half = sample.withColumn("half", F.pmod(F.xxhash64("id", F.lit(7)), F.lit(2)))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(F.broadcast(half), "id")  # at most max_labelled narrow rows

    def words(it):
        for b in it:
            tox, half = b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False)
            for c in chunks(b.column(0)):
                s, e = c.words()
                pairs = np.unique(np.column_stack([_plain(c, s, e).view(np.int64), c.doc_of(s)]), axis=0)
                at = c.first + pairs[:, 1]
                h, inverse = np.unique(pairs[:, 0], return_inverse=True)
                of = lambda w: pa.array(np.bincount(inverse, weights=w, minlength=len(h)).astype(np.int64))  # noqa: B023, E731
                odd = half[at] == 1
                yield pa.RecordBatch.from_arrays([pa.array(h), of(~odd), of(~odd * tox[at]), of(odd), of(odd * tox[at])], ["word", "n0", "t0", "n1", "t1"])

    base = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    rate = max(base["t"], 0.5) / max(base["n"], 1)
    counts = texts.select("text", "t", "half").mapInArrow(words, "word long, n0 long, t0 long, n1 long, t1 long").groupBy("word").agg(*(F.sum(c).alias(c) for c in ("n0", "t0", "n1", "t1")))
    counts = cut(counts.withColumn("n2", F.col("n0") + F.col("n1")).withColumn("t2", F.col("t0") + F.col("t1")).where("t2 >= 2"))

    def lexicon(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Words of half 0, of half 1, or of both (2), whose rate among toxic documents stays high when shrunk."""
        p = (F.col(f"t{k}") + 3 * rate) / (F.col(f"n{k}") + 3)
        found = counts.withColumn("p", p).where(F.col("p") > 0.5).where(f"t{k} >= 2").orderBy(F.desc("p"), F.desc(f"n{k}"), "word").limit(lexicon_size).collect()
        found.sort(key=lambda r: int(np.int64(r["word"]).view(np.uint64)))
        words = np.array([r["word"] for r in found], np.int64).view(np.uint64)
        return words, np.array([np.log(r["p"] / max(1e-6, 1 - r["p"])) - np.log(rate / max(1e-6, 1 - rate)) for r in found])

    halves = lexicon(0), lexicon(1)

    def features(it):
        for b in it:
            half = b.column(4).to_numpy(zero_copy_only=False)
            x = np.where((half == 1)[:, None], _features(b.column(0), *halves[0]), _features(b.column(0), *halves[1]))  # each half by the other's words
            yield pa.RecordBatch.from_arrays([b.column(1), b.column(2), b.column(3), pa.array(list(x), pa.list_(pa.float64()))], ["id", "q", "t", "x"])

    rows = texts.select("text", "id", "q", "t", "half").mapInArrow(features, "id long, q int, t int, x array<double>").orderBy("id", "x").limit(max_labelled).collect()
    x = np.array([r["x"] for r in rows]).reshape(len(rows), 16)
    low = _logistic(x, np.array([r["q"] == 0 for r in rows], float))
    toxic = _logistic(x, np.array([r["t"] == 1 for r in rows], float))
    return Model(*lexicon(2), low, toxic)


def _strength(n: Column, mean: Column, parent: Column) -> list[Column]:
    """Aggregates from which the method of moments takes the strength of shrinkage."""
    return [F.count("*").alias("groups"), F.sum(n).alias("total"), F.sum(n * (mean - parent) ** 2).alias("between"), F.sum(n * n).alias("squares"), F.sum(n * parent).alias("rate")]


def _kappa(r) -> float:
    """Pseudo-count of a beta prior whose spread is what groups show beyond sampling noise."""
    if not r["groups"] or r["groups"] < 2 or not r["total"]:
        return 100.0
    p = min(max(r["rate"] / r["total"], 1e-4), 1 - 1e-4)
    noise = p * (1 - p)
    size = (r["total"] - r["squares"] / r["total"]) / (r["groups"] - 1)
    spread = (r["between"] / (r["groups"] - 1) - noise) / max(size, 1e-9)
    return float(np.clip(noise / spread - 1, 5.0, 10_000.0)) if spread > 1e-9 else 10_000.0


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, float]:
    """Rejection rates of the sites of evidence(host, path, p): one row per (host, path), and the global rate."""
    paths = evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"))
    paths = cut(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    g = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s")).first()
    rate = float(np.clip((g["s"] or 0.0) / max(g["n"] or 0, 1), 1e-4, 1 - 1e-4))
    kh = _kappa(hosts.agg(*_strength(F.col("hn"), F.col("hs") / F.col("hn"), F.lit(rate))).first())
    hosts = hosts.withColumn("host_p", (F.col("hs") + kh * rate) / (F.col("hn") + kh))
    both = paths.join(hosts, "host")
    kp = _kappa(both.agg(*_strength(F.col("n"), F.col("s") / F.col("n"), F.col("host_p"))).first())
    return both.select("host", "path", "host_p", ((F.col("s") + kp * F.col("host_p")) / (F.col("n") + kp)).alias("path_p")), rate


def classify(docs: DataFrame, model: Model, host_col: str = "source", path_col: str = "lang", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """struct column ``row`` (these columns of the input row, or all) beside p_low, p_toxic, host_p, path_p, p_reject and kept.

    Named columns are kept in a table with the scores, so that texts are scored once; whole rows, which may be long,
    are scored a second time instead of being written.
    """
    tmp = Scratch(docs.sparkSession)
    none = F.lit("\u0000none")
    key = lambda c: F.coalesce(docs[c].cast("string"), none)
    row = F.struct(*(docs[c] for c in columns or docs.columns)).alias("row")
    scored = docs.select(row, key(host_col).alias("host"), key(path_col).alias("path"), model.column(docs[text_col].cast("string")).alias("e"))
    if columns:
        scored = tmp.keep(scored, "scored")
    reject = 1 - (1 - F.col("e.low")) * (1 - F.col("e.toxic"))
    sites, rate = site_posteriors(scored.select("host", "path", reject.alias("p")))
    odds = lambda p: F.log(p) - F.log(1 - p)
    safe = F.least(F.greatest(reject, F.lit(1e-9)), F.lit(1 - 1e-9))
    post = 1 / (1 + F.exp(-(odds(safe) + odds(F.col("path_p")) - float(np.log(rate / (1 - rate))))))
    sites = tmp.keep(sites, "sites")
    # a hot host's rows are not gathered by key: few sites are broadcast, more are met over salts
    joined = scored.join(F.broadcast(sites), ["host", "path"]) if sites.count() <= MAX_BROADCAST else salted_join(scored, sites, ["host", "path"], scored.count())
    return joined.select("row", "host_p", "path_p", F.col("e.low").alias("p_low"), F.col("e.toxic").alias("p_toxic"), post.alias("p_reject"), (post < 0.5).alias("kept"))


def quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Digest of classify(): scores and verdict of every document."""
    out = classify(docs, train(docs, labels), columns=["doc_id"])
    r6 = lambda c: F.round(c, 6).alias(c)
    return out.select(F.col("row.doc_id").alias("doc_id"), r6("p_low"), r6("p_toxic"), r6("host_p"), r6("path_p"), r6("p_reject"), "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the classifier keeps, with their own columns."""
    return classify(docs, train(docs, labels)).where("kept").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
