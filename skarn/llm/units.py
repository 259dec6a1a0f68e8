"""Substring dedup by paragraph hashing (operator 3).

A text falls into sentences: a sentence ends with a word that ends in one of . ! ? and their full-width forms, or
with the last word of a line.  Words are normalised by lower-casing A-Z and dropping ASCII punctuation; words of
nothing else count as none, and sentences without words are passed over.  A unit is a paragraph: the shortest run
of sentences, from any sentence on, that holds at least ``min_words`` words; or the whole text, where it holds fewer.
So a passage is found wherever in a line it stands and however its lines are broken within sentences, while a short
stock line within a text is no unit.  A word counts once more for every LONG_WORD code points that it has, so that
text without spaces falls into units too.

Units' 128-bit digests are grouped over all documents; the occurrence with the smallest rank (doc_id, number of
its first sentence) stays and every other one, in whatever document, is removed, with the white space after it.
Units are judged on the input, not on what is left.  What is removed is reported as code-point ranges of the
original text (maximal, in order); what lies outside them is concatenated.

Only digests are shuffled to find repeats (with map-side minima, so a unit in every document costs one row per
task); then only units whose digest may be repeated, by a bitmap of fixed size, are sent to meet the earliest
ones, very frequent ones over salts.  Texts are shuffled once, to join each with its own list of removals.

A null text counts as empty.  A null id ranks after all others.  Rows with the same id and the same text are
the same document: they keep and lose the same units.  Rows with the same id and different texts rank by the
text's hash.  Empty tables give empty results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skarn.llm.bitmap import bitmap, may_be_in
from skarn.llm.session import Scratch
from skarn.llm.skew import SHARE, salted_join
from skarn.llm.textops import Chunk, U64, _tables, chunks, mix

MIN_WORDS = 16
LONG_WORD = 16
_LAST = 2**63 - 1
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(x) for x in ".!?"]] = True


def sentence_ends(c: Chunk, ws: np.ndarray, we: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word ends a sentence, and where the next word (or the document's end) begins."""
    after = np.append(ws[1:], len(c.data))
    last = np.append(doc[1:] != doc[:-1], True)
    after = np.where(last, c.off[doc + 1], after)
    newlines = np.concatenate([[0], np.cumsum(c.data == 10)])
    stop = _STOP[c.data[we - 1]]
    if (c.data >= 0xE3).any():
        tail = [c.data[np.maximum(we - k, 0)].astype(np.int64) for k in (3, 2, 1)]
        code = (tail[0] << 16) | (tail[1] << 8) | tail[2]
        stop |= (we - ws >= 3) & np.isin(code, [0xE38082, 0xEFBC81, 0xEFBC9F])
    return stop | last | (newlines[after] > newlines[we]), after


def paragraph_digests(c: Chunk, min_words: int) -> tuple[np.ndarray, ...]:
    """Per unit of the chunk: document, number of its first sentence in the document, start, end, and two digests of its words."""
    ws, we = c.words()
    none = (np.zeros(0, np.int64),) * 6
    if not len(ws):
        return none
    doc = c.doc_of(ws)
    ends, after = sentence_ends(c, ws, we, doc)
    keep = ~_PUNCTUATION[c.data]
    at = np.concatenate([[0], np.cumsum(keep)])
    plain = Chunk(c.first, c.data[keep], at[c.off])
    real = at[we] > at[ws]
    h = plain.hashes(at[ws[real]], at[we[real]])
    words = np.concatenate([[0], np.cumsum(real)])
    points = np.concatenate([[0], np.cumsum(keep & ((c.data & 0xC0) != 0x80))])
    weight = np.concatenate([[0], np.cumsum(real * (1 + (points[we] - points[ws]) // LONG_WORD))])
    last = np.flatnonzero(ends)
    first = np.concatenate([[0], last[:-1] + 1])
    lo, hi = words[first], words[last + 1]
    some = hi > lo
    first, last, lo, hi = first[some], last[some], lo[some], hi[some]
    sdoc = doc[first]
    number = np.arange(len(sdoc)) - np.searchsorted(sdoc, sdoc)
    before, upto = weight[first], weight[last + 1]
    to = np.searchsorted(upto, before + min_words)
    ok = to < len(hi)
    ok[ok] = sdoc[to[ok]] == sdoc[ok]
    end = np.searchsorted(sdoc, sdoc, side="right") - 1
    short = (number == 0) & (upto[end] - before < min_words)  # a whole text
    to[short], ok = end[short], ok | short
    a, b = np.flatnonzero(ok), to[ok]
    lo, hi = lo[a], hi[b]
    pw, inv = _tables(len(h) + 1)
    out = []
    for salt in (1, 2):
        p = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h + U64(salt)) * pw[: len(h)])])
        out.append(mix((p[hi] - p[lo]) * inv[lo] + (hi - lo).astype(U64)).view(np.int64))
    return sdoc[a], number[a], ws[first[a]], after[last[b]], *out


def _units(docs: DataFrame, min_words: int) -> DataFrame:
    """(rank, key, number, start, end, a, b) of every unit; start and end count bytes."""
    schema = pa.schema([("rank", pa.int64()), ("key", pa.int64()), ("number", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("a", pa.int64()), ("b", pa.int64())])

    def run(it):
        for batch in it:
            rank, key = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for c in chunks(batch.column(2), lower=True):
                d, number, start, end, a, b = paragraph_digests(c, min_words)
                at = c.off[d]
                cols = (rank[c.first + d], key[c.first + d], number.astype(np.int32), (start - at).astype(np.int32), (end - at).astype(np.int32), a, b)
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema)], schema=schema)

    return docs.select("rank", "key", "text").mapInArrow(run, "rank long, key long, number int, start int, end int, a long, b long")


_CUT = "struct<text: string, spans: array<struct<start: bigint, end: bigint>>>"


def _cut(texts: pa.Array, starts: pa.Array, ends: pa.Array) -> pa.Array:
    """Texts without these byte ranges, and the maximal removed ranges in code points."""
    out = []
    for t, s, e in zip(texts, starts, ends):
        text = t.as_py() or ""
        if not s.is_valid or not len(s):
            out.append({"text": text, "spans": []})
            continue
        raw = text.encode("utf-8", "replace")
        x, y = s.values.to_numpy(zero_copy_only=False).astype(np.int64), e.values.to_numpy(zero_copy_only=False).astype(np.int64)
        order = np.argsort(x, kind="stable")
        x, y = x[order], np.maximum.accumulate(y[order])
        new = np.append(True, x[1:] > y[:-1])  # a gap before
        x, y = x[new], y[np.append(np.flatnonzero(new)[1:] - 1, len(y) - 1)]
        chars = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
        edges = [0, *np.stack([x, y], 1).ravel().tolist(), len(raw)]
        kept = b"".join(raw[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2))
        out.append({"text": kept.decode("utf-8", "replace"), "spans": [{"start": int(p), "end": int(q)} for p, q in zip(chars[x], chars[y])]})
    return pa.array(out, pa.struct([("text", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))


def dedup_units(docs: DataFrame, min_words: int = MIN_WORDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """``row`` (the input row), ``kept_text`` and ``spans`` (removed code-point ranges) of every document."""
    tmp = Scratch(docs.sparkSession)
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), F.coalesce(docs[id_col].cast("long"), F.lit(_LAST)).alias("rank"), F.xxhash64(text).alias("key"), text.alias("text"))
    units = _units(base, min_words)
    first = tmp.keep(units.groupBy("a", "b").agg(F.min(F.struct("rank", "key", "number")).alias("first"), F.count("*").alias("n")).where("n > 1"), "first")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = first.where(F.col("n") > max(5000, total // SHARE))
    some, maybe = may_be_in(units, bitmap(first.select(F.col("a").alias("h")), "seen"), "seen", F.col("a"))
    met = salted_join(some.where(maybe).drop("seen"), first.select("a", "b", "first"), ["a", "b"], total, hot=hot)
    later = met.where(F.struct("rank", "key", "number") > F.col("first")).groupBy("rank", "key").agg(F.collect_set(F.struct("start", "end")).alias("gone"))
    done = base.join(later, ["rank", "key"], "left").withColumn("x", F.arrow_udf(_cut, _CUT)("text", F.col("gone.start"), F.col("gone.end")))
    return done.select("row", F.col("x.text").alias("kept_text"), F.col("x.spans").alias("spans"))


def unit_dedup(docs: DataFrame) -> DataFrame:
    """Digest: what remains of each document, and the removed code-point ranges as text."""
    out = dedup_units(docs)
    spans = F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))), " ")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select(F.col("row.doc_id").alias("doc_id"), F.size("spans").cast("long").alias("n_removed"), removed.alias("n_chars_removed"), spans.alias("removed"), F.col("kept_text").alias("text"))


ORACLE = """
WITH pieces AS (
  SELECT doc_id, unnest(p) AS piece, generate_subscripts(p, 1) AS k, strlen_before
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*') AS p,
               length(regexp_extract(coalesce(text, ''), '^[\\x20\\x09-\\x0D]*')) AS strlen_before FROM documents)),
words AS (
  SELECT doc_id, k, piece, regexp_extract(piece, '^[^\\x20\\x09-\\x0D]+') AS word,
         strlen_before + sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY k) - length(piece) AS start FROM pieces),
marked AS (
  SELECT *, regexp_replace(translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[!-/:-@\\[-`{-~]', '', 'g') AS w,
         coalesce(sum((contains(piece, chr(10)) OR regexp_matches(word, '[.!?。！？]$'))::INT)
                  OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM words),
sentences AS (
  SELECT doc_id, sentence, min(k) AS k0, max(k) AS k1, count(*) FILTER (w <> '') AS n, sum(1 + length(w) // 16) FILTER (w <> '') AS weight, list(w ORDER BY k) FILTER (w <> '') AS ws
  FROM marked GROUP BY doc_id, sentence HAVING count(*) FILTER (w <> '') > 0),
counted AS (
  SELECT *, sum(n) OVER x::BIGINT AS upto, sum(weight) OVER x::BIGINT AS weighed FROM sentences WINDOW x AS (PARTITION BY doc_id ORDER BY sentence)),
starts AS (SELECT doc_id, sentence, k0, upto - n AS before, weighed - weight + 16 AS wanted FROM counted),
units AS (
  SELECT s.doc_id, s.sentence, s.k0, e.k1, s.before, e.upto FROM starts s ASOF JOIN counted e ON s.doc_id = e.doc_id AND s.wanted <= e.weighed
  UNION ALL SELECT doc_id, min(sentence), min(k0), max(k1), 0, max(upto) FROM counted GROUP BY doc_id HAVING max(weighed) < 16),
flat AS (SELECT doc_id, flatten(list(ws ORDER BY sentence)) AS ws FROM counted GROUP BY doc_id),
judged AS (
  SELECT u.doc_id, k0, k1, row_number() OVER (PARTITION BY array_to_string(ws[before + 1 : upto], ' ') ORDER BY u.doc_id, sentence) > 1 AS gone
  FROM units u JOIN flat USING (doc_id)),
edges AS (SELECT doc_id, k0 AS k, 1 AS d FROM judged WHERE gone UNION ALL SELECT doc_id, k1 + 1, -1 FROM judged WHERE gone),
steps AS (SELECT doc_id, k, sum(d) AS d FROM edges GROUP BY doc_id, k),
covered AS (SELECT m.doc_id, m.k, m.piece, m.start, coalesce(sum(d) OVER (PARTITION BY m.doc_id ORDER BY m.k), 0) > 0 AS gone FROM marked m LEFT JOIN steps USING (doc_id, k)),
runs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - row_number() OVER (PARTITION BY doc_id, gone ORDER BY k) AS run FROM covered),
spans AS (SELECT doc_id, run, min(start)::BIGINT AS s, sum(length(piece))::BIGINT AS n FROM runs WHERE gone GROUP BY doc_id, run),
removed AS (SELECT doc_id, count(*) AS n_removed, sum(n)::BIGINT AS chars, string_agg(s || '-' || (s + n), ' ' ORDER BY s) AS removed FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(piece, '' ORDER BY k) FILTER (NOT gone) AS text FROM covered GROUP BY doc_id)
SELECT doc_id, coalesce(n_removed, 0) AS n_removed, coalesce(chars, 0) AS n_chars_removed, coalesce(removed, '') AS removed,
       regexp_extract(coalesce(d.text, ''), '^[\\x20\\x09-\\x0D]*') || coalesce(kept.text, '') AS text
FROM documents d LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
