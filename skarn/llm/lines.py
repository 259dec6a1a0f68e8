"""Line dedup by an exact set-similarity join (operator 5, native: DataFrame expressions only).

A line is a \\n-split piece of a text with at least ``min_words`` distinct words; its set holds those words.
Every line that has an earlier line, by (doc_id, text's hash, line number) over the whole corpus, with a Jaccard
similarity of at least ``percent`` / 100 is removed.  Lines are judged on the input.

* Lines of equal sets collapse first: all but the earliest go, and only that one enters the join.
* Words are ordered by rarity: their hashes fall into ``BUCKETS`` classes, ranked by how often the corpus uses
  them.  Any order common to all lines keeps the join exact; counting classes keeps it a table of fixed size.  With
  few classes each holds so many words that rare ones cannot be told from others, and lists grow long.
* Prefix filter: two sets that reach the threshold share a word among the first n - ceil(t n) + 1 of each.
  Only those words are listed, and words listed once are dropped.  Length and positional filters prune pairs,
  and so does a parity sketch of each set: every bit in which two sketches differ takes one word that only one
  of the sets has, so no pair within the threshold is lost.  It has 128 bits, and for lines of over WIDE words,
  of which so few bits would tell little, 512 more.
* Every line is compared with one other first, the first line of one of its lists.  Lines that do not match it
  take the closest of those beside them in a list, in blocks of about 64 by bits of their sketches, and only those that
  match neither are compared with all candidates.  So a line in thousands of variants costs a star of pairs.
* Entries are what is shuffled most, so they hold a word, the line's number and sketches, and nothing else of the line.
  Words are dealt over TURNS, one after the other: each turn's shuffle files go before the next one's are written.
* Jaccard is verified on the full sets, made again for the lines in question only (a bitmap of fixed size
  passes few others).
* Words that lead many lists, copied lines and much-compared lines are counted; those with a large share of the
  rows are broadcast or dealt over salts, whose number is bounded.

A null text has one empty line.  A null id ranks last.  Rows with the same id, null included, and the same text
are the same document: they keep and lose the same lines.  Rows with the same id and different texts are
different documents and rank by the text's hash.  Lines of fewer words always stay.  Empty tables give empty
results.  Input columns keep their names and values, but for the text (and ``n_chars``, where the table has it).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.bitmap import bitmap, cascade, may_be_in, not_in
from skarn.llm.session import Scratch
from skarn.llm.skew import salted_join

PERCENT = 80
MIN_WORDS = 5
BUCKETS = 1 << 16
HOT_BITS = 12
#: Lists are made and joined in so many turns, by their word, so that no shuffle holds all of them at once.
TURNS = 2
#: Lines of more words have a wide sketch of so many longs as well; it tells lines of up to some 900 words apart.
WIDE, LONGS = 180, 8
_NONE = 2**63 - 1


def _key(text: Column) -> Column:
    """Tells documents of one id apart."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _blanks(text: Column, these: str) -> Column:
    """The text with blanks for these characters; replacing one by one is fast where there are none."""
    for c in these:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(rid, key, no, line) of every line; white space within it is blanks."""
    text = _blanks(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "\t\x0b\x0c\r")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE)).alias("rid"), _key(F.col(text_col)).alias("key"), text.alias("text"))
    # outer: else a filter is inferred that splits once more; the key comes first: else every line carries its text along
    return rows.select("rid", "key", F.posexplode_outer(F.split("text", "\n")).alias("no", "line"))


def rarity(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, int, Callable[[int], int]]:
    """Array of BUCKETS ranks of words, on a scale of logarithms, the words that the corpus uses least first; words in all; the rank of a count."""
    text = _blanks(F.col(text_col).cast("string"), "\t\n\x0b\x0c\r")
    word = docs.select(F.explode_outer(F.split(text, " ")).alias("word")).where("word != ''")
    seen = word.groupBy(F.xxhash64("word").bitwiseAND(F.lit(BUCKETS - 1)).alias("bucket")).count().toArrow()  # at most BUCKETS rows
    rank = lambda n: min(int(4 * math.log2(n + 1)), 127)
    count = dict(zip(seen["bucket"].to_pylist(), seen["count"].to_pylist()))
    ranks = ",".join(str(rank(count.get(b, 0))) for b in range(BUCKETS))
    return F.split(F.lit(ranks), ",").cast("array<tinyint>"), sum(count.values()), rank


def codes(line: Column, ranks: Column) -> Column:
    """The distinct words' hashes led by their rank, ascending, so the rarest come first."""

    def code(h: Column) -> Column:
        rank = F.coalesce(F.get(ranks, h.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")).cast("long"), F.lit(0).cast("long"))
        return F.shiftleft(rank, 48).bitwiseOR(F.shiftrightunsigned(h, 16))

    words = F.array_remove(F.split(line, " "), "")
    return F.sort_array(F.transform(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))), code))


def line_sets(lines: DataFrame, ranks: Column, min_words: int = MIN_WORDS) -> DataFrame:
    """(mid, rid, key, no, codes, n) of lines of at least so many distinct words, mid numbering them in no set way."""
    # the number, being no function of the row, keeps the filter from being pushed down, where it would have the codes made twice
    sets = lines.where(F.length("line") >= 2 * min_words - 1).select(F.monotonically_increasing_id().alias("mid"), "rid", "key", "no", codes(F.col("line"), ranks).alias("codes"))
    return sets.withColumn("n", F.size("codes")).where(F.col("n") >= min_words)


def _sketch(codes: Column, k: int) -> Column:
    """Parities of the numbers of codes that fall into each of 64 classes, of the half of them that k names."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
    half = F.filter(codes, lambda c: c.bitwiseAND(F.lit(64)) == F.lit(64 * k))
    return F.aggregate(half, F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(bit(c)))


def _wide_sketch(codes: Column) -> Column:
    """Parities by 64 * LONGS classes, as a struct of longs."""
    bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), c.bitwiseAND(F.lit(63)).cast("int"))
    of = lambda k: F.filter(codes, lambda c: c.bitwiseAND(F.lit(64 * (LONGS - 1))) == F.lit(64 * k))
    return F.struct(*(F.aggregate(of(k), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseXOR(bit(c))).alias(f"w{k}") for k in range(LONGS)))


def _need(n: Column, percent: int) -> Column:
    return F.ceil(n * F.lit(percent) / F.lit(100.0) - 1e-9)


def _overlap(x: Column, y: Column, percent: int) -> Column:
    """Words that sets of these sizes share at the threshold."""
    return F.ceil((x + y) * F.lit(percent) / F.lit(100.0 + percent) - 1e-9)


def removed_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, key, no) of every line to remove; rid is the id, or the largest long for null, and key the text's hash."""
    tmp = Scratch(docs.sparkSession)
    (ranks, words, rank), lines = rarity(docs, id_col, text_col), _lines(docs, id_col, text_col)
    room = (F.col("n") - _need(F.col("n"), percent) + 1).cast("int")
    place = lambda r="": F.struct(*(F.col(f"{r}{c}") for c in ("rid", "key", "no")))

    sets = line_sets(lines, ranks, min_words).select(
        "mid", "rid", "key", "no", "n",
        F.xxhash64("codes").alias("a"), F.hash("codes", "n").alias("b"), _sketch(F.col("codes"), 0).alias("s0"), _sketch(F.col("codes"), 1).alias("s1"),
        F.when(F.col("n") > WIDE, _wide_sketch(F.col("codes"))).alias("w"), F.slice("codes", F.lit(1), room).alias("prefix"),
    )
    base = tmp.keep(sets, "base")
    total = base.count()

    # lines of equal sets: the earliest stays and stands for them
    copies = tmp.keep(base.groupBy("a", "b").agg(F.min(F.struct("rid", "key", "no", "mid")).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times"), "copies")
    flagged, copied = may_be_in(base, bitmap(copies.select(F.col("a").alias("h")), "copied"), "copied", F.col("a"), "left")
    flagged = flagged.withColumn("is_copied", copied)
    narrow = tmp.keep(salted_join(flagged.where("is_copied").select("mid", "rid", "key", "no", "a", "b"), copies, ["a", "b"], total, "left").drop("a", "b"), "narrow")
    later = tmp.keep(narrow.where(F.col("first").isNotNull() & (place() > F.struct("first.rid", "first.key", "first.no"))).select("rid", "key", "no"), "later")
    firsts = narrow.where(F.col("first").isNull() | (F.col("mid") == F.col("first.mid"))).select("mid")
    once, least = flagged.where("not is_copied"), flagged.where("is_copied").join(firsts, "mid", "left_semi")
    firsts = tmp.keep(once.select("mid", "rid", "key", "no", "n", "s0", "s1", "w", "prefix").union(least.select("mid", "rid", "key", "no", "n", "s0", "s1", "w", "prefix")), "firsts")
    tmp.drop("base")
    tmp.drop("narrow")

    def near(x: str, y: str, wide: bool = False) -> tuple[Column, Column]:
        """Length, positional and sketch filters, and the number of bits in which sketches differ."""
        n = lambda r: F.shiftright(F.col(f"{r}np"), 32)
        left = lambda r: n(r) - F.col(f"{r}np").bitwiseAND(F.lit((1 << 32) - 1))
        overlap = _overlap(n(x), n(y), percent)
        far = sum((F.bit_count(F.col(f"{x}s{k}").bitwiseXOR(F.col(f"{y}s{k}"))) for k in (0, 1)), F.lit(0))
        apart = n(x) + n(y) - 2 * overlap  # words that only one of two sets within the threshold has, at most
        fits = (100 * F.least(n(x), n(y)) >= percent * F.greatest(n(x), n(y))) & (F.least(left(x), left(y)) >= overlap) & (far <= apart)
        if wide:
            differ = sum((F.bit_count(F.col(f"{x}w.w{k}").bitwiseXOR(F.col(f"{y}w.w{k}"))) for k in range(LONGS)), F.lit(0))
            fits = fits & F.coalesce(differ <= apart, F.lit(True))  # null where one has no wide sketch
        return fits, far

    # (code, block, mid, rid, s0, s1, w, np, c_mid, c_far): every listed prefix word with the first line of its list, and how far that is where it fits
    np = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.col("pos").cast("long")).alias("np")
    entries = firsts.select("mid", "rid", "s0", "s1", "w", "n", F.posexplode("prefix").alias("pos", "code")).select("code", "rid", "mid", "s0", "s1", "w", np)
    many = words >> HOT_BITS  # words in more lines than this are at most 2 ** HOT_BITS
    entry = F.struct("rid", "mid", "s0", "s1", "np")
    hot = tmp.keep(entries.where(F.col("code") >= F.lit(rank(many) << 48)).groupBy("code").agg(F.count("*").alias("times"), F.min(entry).alias("c")).where(F.col("times") > many), "hot")
    own = Window.partitionBy("code")
    # lines that are near one another have most bits of their sketches in common; each list begins with other bits
    alike = F.call_function("shiftleft", F.col("s0"), F.pmod(F.col("code"), F.lit(64)).cast("int"))
    mine = lambda k: F.pmod(F.col("code"), F.lit(TURNS)) == k
    ranked = entries.join(F.broadcast(hot.select("code")), "code", "left_anti")
    ranked = ranked.select("*", F.row_number().over(own.orderBy(alike, "np", "rid", "mid")).alias("nth"), F.count("*").over(own).alias("times"), F.min(entry).over(own).alias("c"))
    ranked = ranked.where("times > 1").withColumn("block", F.shiftright(F.col("nth") - 1, 6)).drop("nth", "times")
    # a list too long to be numbered in one task falls into blocks by hash instead, some 64 rows each
    spread = entries.join(F.broadcast(hot.withColumnRenamed("times", "block")), "code").withColumn("block", F.pmod(F.xxhash64("mid"), F.greatest(F.shiftright("block", 6), F.lit(1))).cast("int") + 1)
    fits, far = near("", "c.")
    first_of_list = F.when((F.col("mid") != F.col("c.mid")) & fits, far)
    made = lambda rows: rows.select("code", "block", "mid", "rid", "s0", "s1", "w", "np", F.col("c.mid").alias("c_mid"), first_of_list.alias("c_far"))
    lists = [tmp.keep(made(ranked.where(mine(k)).unionByName(spread.where(mine(k)))), f"lists-{k}") for k in range(TURNS)]
    ids = tmp.keep(firsts.select("mid", "rid", "key", "no"), "ids")
    tmp.drop("firsts")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """(mid, rid, key, no) of the later lines of the pairs (x, y) that reach the threshold."""
        ends = pairs.select(F.col("x").alias("mid")).union(pairs.select(F.col("y").alias("mid"))).distinct()
        ends = tmp.keep(ends, f"{name}-ends")
        some, wanted = may_be_in(ids, bitmap(ends.select(F.xxhash64("mid").alias("h")), "wanted"), "wanted", F.xxhash64("mid"))
        who = tmp.keep(some.where(wanted).select("mid", "rid", "key", "no").join(ends, "mid", "left_semi"), f"{name}-who")
        mark = F.xxhash64("rid", "key", "no")
        some, there = may_be_in(docs.select(id_col, text_col), bitmap(who.select(F.xxhash64("key").alias("h")), "there"), "there", F.xxhash64(_key(F.col(text_col))))
        some, wanted = may_be_in(_lines(some.where(there), id_col, text_col), bitmap(who.select(mark.alias("h")), "wanted"), "wanted", mark)
        full = some.where(wanted).select("rid", "key", "no", codes(F.col("line"), ranks).alias("codes")).join(who, ["rid", "key", "no"])
        full = tmp.keep(full.select("mid", place().alias("at"), F.size("codes").alias("n"), "codes").dropDuplicates(["mid"]), f"{name}-full")
        side = lambda r: full.select(F.col("mid").alias(r), F.struct("mid", "at", "n", "codes").alias(f"s{r}"))
        both = salted_join(pairs.select("x", "y").join(side("x"), "x"), side("y"), ["y"], total)
        same = F.size(F.array_intersect(F.col("sx.codes"), F.col("sy.codes")))
        both = both.withColumn("same", same).where(100 * F.col("same") >= percent * (F.col("sx.n") + F.col("sy.n") - F.col("same")))
        found = both.select(F.when(F.col("sx.at") > F.col("sy.at"), F.struct("sx.mid", "sx.at")).otherwise(F.struct("sy.mid", "sy.at")).alias("z")).distinct()
        found = tmp.keep(found.select("z.mid", "z.at.*"), name)
        for part in ("ends", "who", "full"):
            tmp.drop(f"{name}-{part}")
        return found

    # each line with the first line of one of its lists
    star = reduce(DataFrame.unionAll, lists).where("c_far is not null").groupBy(F.col("mid").alias("x")).agg(F.min(F.struct(F.col("c_far").alias("far"), F.col("c_mid").alias("y"))).alias("best"))
    star = tmp.keep(star.select("x", "best.y"), "star-pairs")
    settled = verified(star, "star")

    # those that are left with the closest of the other lines in one of their blocks of about 64; the bitmaps leave out settled lines
    def unsettled(done: DataFrame, name: str) -> Callable[[DataFrame], DataFrame]:
        levels, size = cascade(ids, done, "mid", lambda df, level: tmp.keep(df, f"{name}-{level}"))
        return lambda rows: not_in(rows, levels, size, "mid")

    def candidates(x: DataFrame, y: DataFrame, *within: str) -> tuple[DataFrame, Column]:
        # both sides have the same c; comparing them has both read the same columns, so that they can share an exchange
        columns = ("mid", "rid", "s0", "s1", "w", "np")
        x = x.select("code", *within, F.col("c_mid").alias("x_c"), *(F.col(c).alias(f"x_{c}") for c in columns))
        y = y.select("code", *within, "c_mid", *(F.col(c).alias(f"y_{c}") for c in columns))
        fits, far = near("x_", "y_", wide=True)
        return x.join(y, ["code", *within]).where((F.col("x_c") <= F.col("c_mid")) & (F.col("y_rid") <= F.col("x_rid")) & (F.col("y_mid") != F.col("x_mid")) & fits), far

    found, left_out = [], unsettled(settled, "after-star")
    for k, turn in enumerate(lists):
        dealt = turn.drop("c_far").repartition("code", "block")  # one exchange for both sides, which are told apart behind it
        pairs, far = candidates(left_out(dealt), dealt, "block")
        best = pairs.where("y_mid != x_c").groupBy(F.col("x_mid").alias("x")).agg(F.min(F.struct(far.alias("far"), F.col("y_mid").alias("y"))).alias("best"))
        found.append(tmp.keep(best, f"best-{k}"))
    best = reduce(DataFrame.unionAll, found).groupBy("x").agg(F.min("best").alias("best"))
    best = tmp.keep(best.select("x", "best.y"), "best-pairs")
    settled = settled.union(verified(best, "best"))

    # those that matched neither with all candidates
    found, left_out = [], unsettled(settled, "after-best")
    for k, turn in enumerate(lists):
        dealt = turn.drop("block", "c_far").repartition("code")
        rest, _ = candidates(left_out(dealt), dealt)
        found.append(tmp.keep(rest.select(F.col("x_mid").alias("x"), F.col("y_mid").alias("y")).distinct(), f"rest-{k}"))
        tmp.drop(f"lists-{k}")
    rest = tmp.keep(reduce(DataFrame.unionAll, found).distinct(), "rest-pairs")
    matched = settled.union(verified(rest, "rest")).select("rid", "key", "no")
    names = [f"{part}-{k}" for part in ("best", "rest") for k in range(TURNS)] + [f"after-{part}-level{k + 1}" for part in ("star", "best") for k in range(3)]
    for name in ["ids", "copies", "hot", "star-pairs", "best-pairs", "rest-pairs", *names]:
        tmp.drop(name)
    return later.union(matched).distinct()


def line_dedup(docs: DataFrame) -> DataFrame:
    """Digest: lines and removed lines of every document, with the removed line numbers as text."""
    gone = removed_lines(docs).groupBy("rid", "key").agg(F.sort_array(F.collect_set("no")).alias("gone"))
    every = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n_lines"), _key(F.col("text")).alias("key")).withColumn("rid", F.coalesce("doc_id", F.lit(_NONE)))
    out = every.join(gone, ["rid", "key"], "left").withColumn("mine", F.coalesce("gone", F.array().cast("array<int>")))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("mine").cast("long").alias("n_removed"), F.array_join(F.col("mine").cast("array<string>"), " ").alias("removed"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """The documents without their removed lines, with their own columns."""
    gone = removed_lines(docs).groupBy("rid", "key").agg(F.collect_set("no").alias("gone")).select(F.struct("rid", "key", "gone").alias("_found"))
    rid = F.coalesce(docs["doc_id"].cast("long"), F.lit(_NONE))
    both = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), rid.alias("_rid"), _key(docs["text"]).alias("_key")).join(gone, (F.col("_rid") == F.col("_found.rid")) & (F.col("_key") == F.col("_found.key")), "left")
    lines = F.split(F.col("_row.text"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_found.gone"))
    text = F.when(F.col("_found").isNull() | F.col("_row.text").isNull(), F.col("_row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    both = both.withColumn("_text", text)
    changed = {"text": F.col("_text"), "n_chars": F.when(F.col("_found").isNull(), F.col("_row.n_chars")).otherwise(F.length("_text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else None}
    return both.select(*((changed[c] if c in changed else F.col("_row").getField(c)).alias(c) for c in docs.columns))


ORACLE = """
WITH lines AS (
  SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS no FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
sets AS (
  SELECT row_number() OVER (ORDER BY doc_id, no) AS id, doc_id, no, list_distinct(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS s FROM lines),
items AS (SELECT id, len(s) AS n, unnest(s) AS w FROM sets WHERE len(s) >= 5),
ordered AS (
  SELECT id, n, w, row_number() OVER (PARTITION BY id ORDER BY f, w) AS r FROM (SELECT *, count(*) OVER (PARTITION BY w) AS f FROM items)),
prefix AS (SELECT * FROM ordered WHERE r <= n - ceil(0.8 * n - 1e-9) + 1),
pairs AS (
  SELECT DISTINCT x.id AS x, y.id AS y FROM prefix x JOIN prefix y ON x.w = y.w AND y.id < x.id AND y.n >= 0.8 * x.n - 1e-9 AND x.n >= 0.8 * y.n - 1e-9),
gone AS (
  SELECT DISTINCT x FROM (SELECT x, len(list_intersect(a.s, b.s)) AS i, len(a.s) + len(b.s) AS t FROM pairs JOIN sets a ON a.id = x JOIN sets b ON b.id = y)
  WHERE 100 * i >= 80 * (t - i))
SELECT doc_id, count(*) AS n_lines, count(x) AS n_removed, coalesce(string_agg(no::VARCHAR, ' ' ORDER BY no) FILTER (x IS NOT NULL), '') AS removed
FROM sets LEFT JOIN gone ON id = x GROUP BY doc_id
"""
