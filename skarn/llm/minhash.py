"""Near-duplicate documents by bottom-k sketches (operator 4).

A document's set holds its distinct ``width``-word shingles (A-Z lower-cased; with fewer words the whole
sequence), as 64-bit hashes.  Documents of equal sets form one class, so copies cost one narrow row each.

* Sketch: the ``K`` smallest hashes of the set, from the one hash function.
* Inverted lists of retained values give overlaps.  For Jaccard j the number of common values among the K
  smallest of the union is binomial(K, j); at j = 0.75 fewer than ``SHARED`` occur with probability below
  1e-7, and common ones are in both sketches.  So a pair must share one of the K - SHARED + 1 values that are
  rarest in the corpus of its sketches, and only these are listed: common passages make no candidates.
  Documents whose set is at most 3/4 K are held whole by the sketch, and their bound is exact.
* In every list each class is compared with the list's centre, the class with the fewest values that no other
  class retains: among edited copies that is the text they were made from, if it is there.  The links found join classes into
  components; after that only pairs of one list that are still in different components are compared: pair by
  pair in lists of at most ``LARGE`` classes.  The members of longer lists take the exact way: a prefix join
  on their full sets, ordered by rarity among them, with length and positional filters, which leaves near
  misses alone.  So neither a large group of near copies nor one of near misses costs its square, and no link
  between components is lost.
* The union sketch of a pair estimates its Jaccard; what could reach the threshold is verified exactly on the
  full sets, made from the two whole texts.

A class is named by 64 bits of its set's digest.
A document without words or text is linked with nothing: its component is its own id.  A null id never names
a component unless all ids in it are null.  Rows of one id and one text are alike in every output column.
Empty tables give empty results.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from skarn.llm.bitmap import bitmap, may_be_in
from skarn.llm.graph import components
from skarn.llm.session import Scratch, cut
from skarn.llm.session import width as width_of
from skarn.llm.textops import U64, chunks, grams, mix

WIDTH = 5
PERCENT = 75
K = 48
SHARED = 19
LARGE = 32
STARS = 1
_NONE = 2**63 - 1  # stands for a null id


def shingle_sets(texts: pa.Array, width: int):
    """Per chunk: first row, rows, and the distinct shingle hashes (63 bits, sorted) with their document."""
    for c in chunks(texts, lower=True):
        start, end = c.words()
        doc = c.doc_of(start)
        words = c.hashes(start, end)
        h, at = grams(words, doc, width)
        d = doc[at]
        n = np.bincount(doc, minlength=c.n)
        few = np.flatnonzero((n > 0) & (n < width))
        if len(few):
            bound = np.searchsorted(doc, np.arange(c.n + 1))
            whole = np.zeros(len(few), U64)
            for j in range(width - 1):
                more = n[few] > j
                whole[more] = whole[more] * U64(0xF1357AEA2E62A9C5) + words[bound[few[more]] + j]
            h, d = np.concatenate([h, mix(whole + n[few].astype(U64))]), np.concatenate([d, few])
        h = (h >> U64(1)).view(np.int64)
        o = np.lexsort((h, d))
        h, d = h[o], d[o]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        yield c.first, c.n, h[new], d[new]


def _digests(h: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit digests of each set h[at[i]:at[i + 1]]."""
    out = []
    for salt in (11, 29):
        s = np.concatenate([np.zeros(1, U64), np.cumsum(mix(h.view(U64) + U64(salt)))])
        out.append(mix(s[at[1:]] - s[at[:-1]] + U64(salt)).view(np.int64))
    return out


def _digest(width: int):
    """struct(a, b) of each text's set."""

    def run(texts: pa.Array) -> pa.Array:
        parts = [_digests(h, np.searchsorted(d, np.arange(rows + 1))) for _, rows, h, d in shingle_sets(texts, width)]
        a, b = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (0, 1))
        return pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return F.arrow_udf(run, "a long, b long")


def sketches(docs: DataFrame, k: int = K, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n (set size), a, b (digest of the set; equal sets have equal ones) and sketch of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sketch", pa.list_(pa.int64()))])

    def run(it):
        for batch in it:
            ids = batch.column(0)
            for first, rows, h, d in shingle_sets(batch.column(1), width):
                n = np.bincount(d, minlength=rows)
                at = np.searchsorted(d, np.arange(rows + 1))
                digest = _digests(h, at)
                low = np.arange(len(h)) - at[d] < k
                off = np.concatenate([[0], np.cumsum(np.minimum(n, k))]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(off), pa.array(h[low]))
                yield pa.RecordBatch.from_arrays([ids.slice(first, rows), pa.array(n.astype(np.int64)), *map(pa.array, digest), lists], schema=schema)

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return src.mapInArrow(run, "doc_id long, n long, a long, b long, sketch array<long>")


def _estimate(k: int, shared: int, percent: int):
    """Whether two sketches leave room for the threshold: by their union sketch, or exactly if both hold whole sets."""

    def run(sa: pa.Array, na: pa.Array, sb: pa.Array, nb: pa.Array) -> pa.Array:
        big = np.iinfo(np.int64).max
        m = len(sa)
        both = np.full((m, 2 * k), big)
        for s, at in ((sa, 0), (sb, k)):
            flat, off = s.flatten().to_numpy(zero_copy_only=False), s.offsets.to_numpy() - s.offsets[0].as_py()
            n = np.diff(off)
            both[np.repeat(np.arange(m), n), at + np.arange(len(flat)) - np.repeat(off[:-1], n)] = flat
        both.sort(axis=1)
        twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != big)
        rank = np.arange(2 * k - 1)[None, :] - (np.cumsum(twice, axis=1) - twice)  # distinct values before this one
        common = (twice & (rank < k)).sum(axis=1)
        na, nb = na.to_numpy(zero_copy_only=False), nb.to_numpy(zero_copy_only=False)
        whole = (na <= k) & (nb <= k)
        every = twice.sum(axis=1)
        exact = 100 * every >= percent * (na + nb - every)
        return pa.array(np.where(whole, exact, common >= np.minimum(shared, -(-percent * np.minimum(na, nb) // 100))))

    return F.arrow_udf(run, "boolean")


def _verify(width: int, percent: int):
    """Whether two texts' full sets reach the threshold."""

    def run(ta: pa.Array, tb: pa.Array) -> pa.Array:
        out = []
        m = len(ta)
        both = pa.concat_arrays([ta.cast(pa.large_string()), tb.cast(pa.large_string())])
        sets: list[np.ndarray] = []
        for _, rows, h, d in shingle_sets(both, width):
            at = np.searchsorted(d, np.arange(rows + 1))
            sets += [h[at[i] : at[i + 1]] for i in range(rows)]
        for x, y in zip(sets[:m], sets[m:]):
            z = np.concatenate([x, y])
            z.sort()
            common = int((z[1:] == z[:-1]).sum())
            out.append(common > 0 and 100 * common >= percent * (len(z) - common))
        return pa.array(out, pa.bool_())

    return F.arrow_udf(run, "boolean")


def _room(n: Column, size: Column, k: int, shared: int, percent: int) -> Column:
    """Values of a sketch to list: all but as many as a pair must share."""
    need = F.when(n * 100 <= percent * k, F.ceil(n * percent / 100.0 - 1e-9)).otherwise(F.lit(shared)).cast("int")
    return size - need + 1


def _rarest(values: DataFrame, room: Column) -> DataFrame:
    """(value, node, pos, own, ...) of each node's room rarest values; own: its values that no other node holds, left out.

    values has node, value, size (values of the node) and what room needs.  Values seen once are the rarest and take
    the first places.
    """
    often = values.withColumn("f", F.count("*").over(Window.partitionBy("value"))).where("f > 1")
    w = Window.partitionBy("node")
    ranked = often.withColumn("r", F.row_number().over(w.orderBy("f", "value"))).withColumn("own", F.col("size") - F.count("*").over(w)).withColumn("pos", F.col("r") + F.col("own") - 1)
    return ranked.where(F.col("pos") < room).drop("f", "r")


def _length_fits(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, size, value) of every shingle of some classes."""
    schema = pa.schema([("node", pa.int64()), ("size", pa.int32()), ("value", pa.int64())])

    def run(it):
        for batch in it:
            node = batch.column(0).to_numpy(zero_copy_only=False)
            for first, rows, h, d in shingle_sets(batch.column(1), width):
                n = np.bincount(d, minlength=rows).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(node[first + d]), pa.array(n[d]), pa.array(h)], schema=schema)

    return texts.select("node", "text").mapInArrow(run, "node long, size int, value long")


def _texts_of(docs: DataFrame, nodes: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(node, text) of some classes(node, b, rep): of the rows with the class's id, one whose set has its digest."""
    rep = F.coalesce(F.col(id_col).cast("long"), F.lit(_NONE))
    all_ = docs.select(rep.alias("rep"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    some, wanted = may_be_in(all_, bitmap(nodes.select(F.xxhash64("rep").alias("h")), "wanted"), "wanted", F.xxhash64("rep"))
    own = some.where(wanted).select("rep", "text").join(nodes, "rep").withColumn("digest", _digest(width)("text"))
    return own.where("digest.a = node and digest.b = b").groupBy("rep", "node").agg(F.min("text").alias("text")).select("node", "text")


def linked_classes(docs: DataFrame, classes: DataFrame, k: int, shared: int, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Verified links (u, v) between classes; together they connect all classes that any chain of links connects."""
    tmp, tables = Scratch(docs.sparkSession), count()

    def keep(df: DataFrame) -> DataFrame:
        """A table in the shared folder; the shuffle files behind it go at once, not when the driver happens to collect its garbage."""
        return tmp.keep(df, f"links-{next(tables)}")

    listed = _rarest(classes.select("node", F.size("sketch").alias("size"), "n", F.explode("sketch").alias("value")), _room(F.col("n"), F.col("size"), k, shared, percent))
    lists = listed.select("value", "node", "n", "own")
    lists = keep(lists.withColumn("c", F.count("*").over(Window.partitionBy("value"))).where("c > 1"))
    some = keep(classes.join(lists.select("node").distinct(), "node", "left_semi"))
    texts = keep(_texts_of(docs, some.select("node", "b", "rep"), width, id_col, text_col))

    def verified(pairs: DataFrame) -> DataFrame:
        u = some.select(F.col("node").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
        v = some.select(F.col("node").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
        both = pairs.join(u, "u").join(v, "v").where(_length_fits(F.col("nu"), F.col("nv"), percent))
        both = keep(both.where(_estimate(k, shared, percent)("su", "nu", "sv", "nv")).select("u", "v"))
        tu, tv = (texts.select(F.col("node").alias(x), F.col("text").alias(f"t{x}")) for x in ("u", "v"))
        return keep(both.join(tv, "v").join(tu, "u").where(_verify(width, percent)("tu", "tv")).select("u", "v"))

    def apart(rows: DataFrame, *positions) -> DataFrame:
        """Pairs (u, v) of one list that are in different components."""
        extra = [c for c in ("pos", "centre") if c in rows.columns]
        x = rows.select("value", F.col("node").alias("u"), F.col("n").alias("nu"), F.col("root").alias("ru"), *(F.col(c).alias(f"{c}u") for c in extra))
        y = rows.select("value", F.col("node").alias("v"), F.col("n").alias("nv"), F.col("root").alias("rv"), *(F.col(c).alias(f"{c}v") for c in extra))
        test = (F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & _length_fits(F.col("nu"), F.col("nv"), percent)
        for p in positions:
            test = test & p
        return x.join(y, "value").where(test).select("u", "v").distinct()

    # stars: every class against the centre of each of its lists, the class with the fewest values of its own
    first = lists.groupBy("value").agg(F.min(F.struct("own", "node")).alias("x")).select("value", F.col("x.node").alias("u"))
    links = verified(lists.join(first, "value").where("node != u").select("u", F.col("node").alias("v")).distinct())
    root = components(links).withColumnRenamed("u", "node")
    placed = lists.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("value")
    left = keep(placed.join(mixed, "value", "left_semi"))
    # short lists: what the stars left apart, pair by pair (at most LARGE pairs a row)
    tasks = width_of(docs.sparkSession)  # unions would add up their inputs' partitions
    links = links.union(verified(apart(left.where(F.col("c") <= LARGE)))).coalesce(tasks)
    # long lists: their members by the exact prefix join on full sets
    members = left.where(F.col("c") > LARGE).select("node", "root").distinct()
    if members.isEmpty():
        return links
    sets = _full_sets(texts.join(members, "node", "left_semi"), width).withColumn("n", F.col("size").cast("long"))
    need = F.ceil(F.col("size") * percent / 100.0 - 1e-9).cast("int")
    prefix = keep(_rarest(sets, F.col("size") - need + 1).select("value", "node", "n", "own", "pos"))
    overlap = F.ceil((F.col("nu") + F.col("nv")) * percent / (100.0 + percent) - 1e-9)
    fits = F.least(F.col("nu") - F.col("posu"), F.col("nv") - F.col("posv")) >= overlap

    def rooted(rows: DataFrame) -> DataFrame:
        known = components(links).withColumnRenamed("u", "node")
        return keep(rows.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")))

    # stars here too, around the most central members, before pairs
    for turn in range(STARS):
        rows = rooted(prefix)
        w = Window.partitionBy("value").orderBy("own", F.xxhash64("node", F.lit(turn)))
        rows = rows.join(rows.withColumn("place", F.row_number().over(w)).where(F.col("place") == turn + 1).select("value", F.col("node").alias("centre")), "value")
        links = keep(links.union(verified(apart(rows, fits, (F.col("u") == F.col("centreu")) | (F.col("v") == F.col("centrev"))))).coalesce(tasks))
    return links.union(verified(apart(rooted(prefix), fits)))


def _placed(docs: DataFrame, k: int = K, shared: int = SHARED, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, a, b (digest of the set) and of sets that are not empty root and least id of the component, of every document."""
    rows = cut(sketches(docs, k, width, id_col, text_col))
    least = rows.where("n > 0").groupBy("a", "b").agg(F.min(F.struct(F.coalesce("doc_id", F.lit(_NONE)).alias("rep"), "n", "sketch")).alias("x"), F.count("doc_id").alias("named"))
    classes = cut(least.select(F.col("a").alias("node"), "b", "x.rep", "x.n", "x.sketch", "named"))
    root = components(linked_classes(docs, classes, k, shared, width, percent, id_col, text_col)).withColumnRenamed("u", "node")
    named = classes.select("node", "b", "rep", "named").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least_id = named.groupBy("root").agg(F.when(F.sum("named") > 0, F.min("rep")).alias("component"))  # null where no member has an id
    named = named.join(least_id, "root").select(F.col("node").alias("a"), "b", "root", "component")
    return rows.select("doc_id", "n", "a", "b").join(named, ["a", "b"], "left")


def near_duplicates(docs: DataFrame, k: int = K, shared: int = SHARED, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    out = _placed(docs, k, shared, width, percent, id_col, text_col)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay, one row of each group of near duplicates, with their own columns.

    A row is known by its id, null included, and its set's digest: the least of a group stays, and one of its
    copies.  Documents with empty sets stay.
    """
    me = ["id", "a", "b"]
    rows = _placed(docs).where("n > 0").select(F.coalesce("doc_id", F.lit(_NONE)).alias("id"), "a", "b", "root")
    keys = rows.groupBy(*me, "root").agg(F.count("*").alias("times"))
    least = keys.groupBy("root").agg(F.min(F.struct(*me)).alias("least"))
    judged = cut(keys.join(least, "root").select(*me, (F.struct(*me) == F.col("least")).alias("stays"), "times"))
    gone = judged.where("not stays").select(*me)
    repeated = judged.where("stays and times > 1").select(*me)
    row = F.struct(*(docs[c] for c in docs.columns)).alias("row")
    digest = _digest(WIDTH)(F.coalesce(docs["text"].cast("string"), F.lit("")))
    known = docs.select(row, F.coalesce(docs["doc_id"].cast("long"), F.lit(_NONE)).alias("id"), digest.alias("d")).select("row", "id", "d.a", "d.b").join(gone, me, "left_anti")
    columns = [F.col("row").getField(c).alias(c) for c in docs.columns]
    if repeated.isEmpty():
        return known.select(*columns)
    known = cut(known)
    one = known.join(repeated, me, "left_semi").groupBy(*me).agg(F.min("row").alias("row"))
    return known.join(repeated, me, "left_anti").select(*columns).union(one.select(*columns))


ORACLE = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END AS s FROM words),
items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM items a JOIN items b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM sets UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u)
SELECT doc_id, len(s)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least ON u = doc_id
"""
