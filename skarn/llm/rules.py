"""Quality rules by weak supervision (operator 10).

Each rule looks at surface statistics of a whole text and votes good (+1) or bad (-1) or abstains (0).
Expectation-maximisation over all documents estimates, per rule, how often it casts each vote on good and
on bad documents, without labels.  EM needs only how often each combination of votes occurs: a table of at
most 3 ** len(RULES) rows whatever the corpus, counted with map-side aggregation.  A document is kept when
its posterior probability of being good is at least ``min_posterior``, unless a base rule fails it.

Null texts count as empty: no words, so ``base_failed``.  An empty table gives an empty result.  Repeated
rows and null ids are scored like any others, one output row per input row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.llm.features import STATS, document_stats
from skarn.llm.session import cut

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Prior rates of a bad vote on a good and on a bad document, and the number of documents that they count as.
FALSE_ALARM, HIT, PSEUDO = 0.002, 0.3, 1000
#: A rule is written so that at most this share of its votes on good documents are bad.  It is what tells the classes apart:
#: without it, EM calls whatever is frequent good.
MOST_FALSE = 0.02


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(good, 1).when(bad, -1).otherwise(0)


#: name -> (vote good if, vote bad if)
RULES: dict[str, tuple] = {
    "word_length": (lambda: _ratio("word_chars", "n_words").between(3.0, 9.0), lambda: ~_ratio("word_chars", "n_words").between(2.0, 12.0)),
    "symbols": (lambda: _ratio("n_symbols", "n_words") < 0.02, lambda: _ratio("n_symbols", "n_words") > 0.1),
    "letters": (lambda: _ratio("n_letters", "word_chars") > 0.85, lambda: _ratio("n_letters", "word_chars") < 0.7),
    "repeats": (lambda: _ratio("n_repeat_words", "n_words") < 0.15, lambda: _ratio("n_repeat_words", "n_words") > 0.3),
    "lines": (lambda: _ratio("n_dup_lines", "n_lines") < 0.1, lambda: _ratio("n_dup_lines", "n_lines") > 0.4),
    "capitals": (lambda: _ratio("n_upper", "n_letters") < 0.1, lambda: _ratio("n_upper", "n_letters") > 0.3),
    "exclaims": (lambda: _ratio("n_bang", "n_words") < 0.02, lambda: _ratio("n_bang", "n_words") > 0.1),
    "tables": (lambda: _ratio("n_pipe", "n_words") < 0.02, lambda: _ratio("n_pipe", "n_words") > 0.1),
    "variety": (lambda: _ratio("n_varied", "n_words") > 0.25, lambda: _ratio("n_varied", "n_words") < 0.2),
}


def with_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id and the STATS of its text."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc_id", pa.int64()), *((k, pa.int64()) for k in STATS)])

    def run(it):
        for b in it:
            s = document_stats(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(s[k]) for k in STATS)], schema=schema)

    return src.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in STATS))


def votes(stats: DataFrame) -> DataFrame:
    return stats.withColumns({f"vote_{k}": _vote(good(), bad()) for k, (good, bad) in RULES.items()})


def fit(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.85, rounds: int = 200) -> np.ndarray:
    """Posterior probability of good for each row of patterns (votes -1, 0, 1), seen counts times.

    Classes start from the balance of votes.  The priors say what the rules were written for: a bad vote on a
    good document is rare.  They count as PSEUDO documents, so that the data decide wherever there are more, but for
    two anchors: a good class's rate of bad votes stays under MOST_FALSE, and the bad class's is never below it.
    """
    if not len(patterns):
        return np.zeros(0)
    n, m = patterns.shape
    counts = counts.astype(float)
    bad = (patterns == -1).sum(axis=1)
    post = np.where(bad == 0, 0.98, 0.1)
    total = counts.sum()
    for _ in range(rounds):
        w1, w0 = counts * post, counts * (1 - post)
        p = (w1.sum() + PSEUDO * prior) / (total + PSEUDO)
        logit = np.full(n, np.log(p) - np.log(1 - p))
        for j in range(m):
            bad_vote, good_vote = patterns[:, j] == -1, patterns[:, j] == 1
            voted = bad_vote | good_vote  # abstaining says nothing about the class
            a = min((w1[bad_vote].sum() + FALSE_ALARM * PSEUDO) / (w1[voted].sum() + PSEUDO), MOST_FALSE)
            b = max((w0[bad_vote].sum() + HIT * PSEUDO) / (w0[voted].sum() + PSEUDO), a)
            logit[bad_vote] += np.log(a) - np.log(b)
            logit[good_vote] += np.log(1 - a) - np.log(1 - b)
        new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_posterior: float = 0.5) -> DataFrame:
    """Statistics, votes, posterior and verdict of every document (see the module's docstring)."""
    spark = docs.sparkSession
    names = [f"vote_{k}" for k in RULES]
    stats = cut(votes(with_stats(docs, id_col, text_col)))
    seen = stats.groupBy(*names).count().orderBy(*names).collect()  # at most 3 ** len(RULES) rows
    patterns = np.array([[r[k] for k in names] for r in seen], int).reshape(len(seen), len(names))
    post = fit(patterns, np.array([r["count"] for r in seen]))
    rows = [(*map(int, p), float(x)) for p, x in zip(patterns, post)]
    table = spark.createDataFrame(rows, ", ".join(f"{k} int" for k in names) + ", posterior double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return (
        stats.join(F.broadcast(table), names)  # bounded as above
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= min_posterior))
        .select("doc_id", *STATS[:5], "base_failed", "kept", *STATS[5:], *names, F.round("posterior", 6).alias("posterior"))
    )
