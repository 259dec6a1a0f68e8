"""Source divergence audit (operator 11): how a language's sources differ from one another and from the whole, by term.

1. Map tasks cut texts into terms and give one row of counts for each (lang, source, term) that they hold.
2. Rows are hashed into shards by lang and term.  A shard is a small DuckDB table: SQL adds the counts, keeps terms
   with at least ``min_docs`` documents of the language, and gives every kept count.
3. Spark adds the kept counts to the totals of each group and language, which fix the shares p of all terms.
4. Shards again, by lang, term and two blocks of sources: SQL gives partial sums of pairs, the ``top`` terms of each
   group in this shard, and how often each share occurs in a group.  Spark adds the sums and ranks.

A pair's sum over all kept terms needs no row for terms that a source lacks: with z the share of a term that does not
occur, sum |p - q| = V |z - z'| + what each side's own terms change + what their common terms change beyond that.  The
second part needs only how often each share occurs, the third only rows of terms that both have.  Sources are dealt
into blocks of about BLOCK, and a shard joins two blocks at a time, so a term that all sources have is split too.

Null text, lang and source count as ''.  Repeated rows and repeated or null ids are documents of their own; ids are
not read.  Bytes that are no UTF-8 become U+FFFD.  A language without kept terms has pairs of value 0 and no terms; a
language with one source has no pairs.  Equal values rank by the item's UTF-8 bytes.  A text of any length is cut whole.
An empty table gives no rows.  All arithmetic is in integers (of 128 bits where products need them).
"""

from __future__ import annotations

from collections import Counter
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skarn.llm.session import cut, width

MIN_DOCS, TOP, SMOOTH, ONE = 30, 50, 5, 1_000_000_000
#: Sources that meet in a shard: two blocks of about so many.
BLOCK = 256
#: Counts that a map task holds before it gives them out, and a shard's memory in DuckDB.
HELD, MEMORY = 400_000, "600MB"

_UPPER, _LOWER = bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B))
#: What stands in no term becomes a blank, A-Z becomes a-z.
_CLEAN = bytes.maketrans(bytes(range(0x41)) + bytes(range(0x5B, 0x61)) + bytes(range(0x7B, 0x80)) + _UPPER, b" " * (0x41 + 6 + 5) + _LOWER)


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    if not text.isascii():
        try:
            text.decode()
        except UnicodeDecodeError:
            text = text.decode("utf-8", "replace").encode()
    return text.translate(_CLEAN).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), d (documents): partial counts, several rows a key."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])

    def out(held: dict):
        for (lang, source), (n, d) in held.items():
            keys = pa.array(list(n), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), keys, pa.array(n.values(), pa.int64()), pa.array([d[t] for t in n], pa.int64())], schema=schema)
        held.clear()

    def run(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                words = terms(text.as_py())
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                size -= len(n)
                n.update(words)
                d.update(set(words))
                size += len(n)
                if size > HELD:
                    yield from out(held)
                    size = 0
        yield from out(held)

    return docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(run, "lang string, source string, term string, n long, d long")


def in_shards(rows: DataFrame, shards: int, by: list[str], sql: str, schema: str, memory: str = MEMORY) -> DataFrame:
    """The result of sql over the table ``shard`` of each shard; rows that agree in ``by`` share one."""

    def run(batches):
        import duckdb

        first = next(batches, None)
        if first is None:
            return
        with duckdb.connect(config={"threads": 1, "memory_limit": memory, "temp_directory": ""}) as con:
            con.register("arriving", pa.RecordBatchReader.from_batches(first.schema, chain([first], batches)))
            con.execute("CREATE TABLE shard AS SELECT * FROM arriving")
            yield from con.sql(sql).to_arrow_reader(10_000)

    return rows.repartition(shards, *by).mapInArrow(run, schema)


def kept_counts(counts: DataFrame, shards: int, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, source, term, n, total (over the language's sources), lead (true for one row a term) of kept terms."""
    sql = f"""WITH c AS (SELECT lang, source, term, sum(n) AS n, sum(d) AS d FROM shard GROUP BY ALL)
        SELECT lang, source, term, CAST(n AS BIGINT) AS n, CAST(sum(n) OVER t AS BIGINT) AS total, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS "lead"
        FROM c WINDOW t AS (PARTITION BY lang, term) QUALIFY sum(d) OVER t >= {min_docs}"""
    return in_shards(counts, shards, ["lang", "term"], sql, "lang string, source string, term string, n long, total long, lead boolean")


def shard_sums(rows: DataFrame, shards: int, top: int = TOP) -> DataFrame:
    """Tagged rows of the shards: joint (what common terms change in a pair's sum), level (a share and its times), term."""
    share = lambda n, total: f"CAST(1 + CAST({ONE} AS HUGEINT) * ({n} + {SMOOTH}) // ({total} + {SMOOTH} * vocabulary) AS BIGINT)"
    sql = f"""WITH t AS (SELECT *, {share("n", "group_total")} AS p, {share("total", "lang_total")} AS q FROM shard),
        own AS (SELECT * FROM t WHERE low = high),
        best AS (SELECT lang, source, term, p - q AS f, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS r FROM own WHERE p > q)
        SELECT 'joint' AS kind, a.lang, least(a.source, b.source) AS source, greatest(a.source, b.source) AS item,
            CAST(sum(abs(a.p - b.p) - abs(a.p - b.z) - abs(b.p - a.z) + abs(a.z - b.z)) AS BIGINT) AS x, CAST(0 AS BIGINT) AS y
        FROM t a JOIN t b ON a.lang = b.lang AND a.term = b.term AND a.low = b.low AND a.high = b.high
            AND a.block = a.low AND b.block = a.high AND (a.low < a.high OR a.source < b.source) GROUP BY ALL
        UNION ALL SELECT 'level', lang, source, NULL, p, count(*) FROM own GROUP BY lang, source, p
        UNION ALL SELECT 'term', lang, source, term, f, 0 FROM best WHERE r <= {top}"""
    return in_shards(rows, shards, ["lang", "term", "low", "high"], sql, "kind string, lang string, source string, item string, x long, y long")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, shards: int | None = None, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank (see the module's docstring)."""
    shards = shards or width(docs.sparkSession)
    src = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    kept = cut(kept_counts(term_counts(src), shards, min_docs))

    langs = kept.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.when(F.col("lead"), 1)).alias("vocabulary"))
    found = src.groupBy("lang", "source").agg(F.lit(1).alias("one")).drop("one")
    blocks = found.groupBy("lang").agg(F.ceil(F.count("*") / block).alias("blocks"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_total"))
    groups = cut(
        found.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").join(blocks, "lang").na.fill(0, ["group_total", "lang_total", "vocabulary"])
        .withColumn("z", F.expr(f"if(vocabulary = 0, 0, 1 + {SMOOTH * ONE}L div (group_total + {SMOOTH} * vocabulary))"))
        .withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks")))
    )

    met = kept.join(groups, ["lang", "source"]).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = met.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    sums = cut(shard_sums(rows.select("lang", "source", "term", "n", "total", "group_total", "lang_total", "vocabulary", "z", "block", "low", "high"), shards, top))

    a = groups.select("lang", "source", "z", "vocabulary")
    b = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("other_z"))
    own = F.col("y") * (F.abs(F.col("x") - F.col("other_z")) - F.abs(F.col("z") - F.col("other_z")))
    sides = (
        sums.where("kind = 'level'").select("lang", "source", "x", "y").join(a, ["lang", "source"]).join(b, "lang").where("source != item")
        .groupBy("lang", F.least("source", "item").alias("source"), F.greatest("source", "item").alias("item")).agg(F.sum(own).alias("change"))
    )
    changes = sides.unionByName(sums.where("kind = 'joint'").select("lang", "source", "item", F.col("x").alias("change"))).groupBy("lang", "source", "item").agg(F.sum("change").alias("change"))
    pairs = a.join(b, "lang").where("source < item").join(changes, ["lang", "source", "item"], "left")
    value = F.col("vocabulary") * F.abs(F.col("z") - F.col("other_z")) + F.coalesce("change", F.lit(0))
    once = pairs.select("lang", F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))).alias("ways"), value.alias("value"))
    both = once.select("lang", F.inline("ways"), "value").select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    best = sums.where("kind = 'term'").select("lang", "source", F.lit("term").alias("part"), "item", F.col("x").alias("value"))

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    return both.withColumn("rank", rank).unionByName(best.withColumn("rank", rank).where(F.col("rank") <= top))


ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t FROM documents),
w AS MATERIALIZED (SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT rid) >= {MIN_DOCS}),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS MATERIALIZED (SELECT DISTINCT lang, source FROM d),
every AS (SELECT lang, source, term, coalesce(n, 0) AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
gp AS MATERIALIZED (SELECT *, 1 + (CAST({ONE} AS HUGEINT) * (n + {SMOOTH})) // (sum(n) OVER x + {SMOOTH} * count(*) OVER x) AS p FROM every WINDOW x AS (PARTITION BY lang, source)),
lp AS (SELECT lang, term, 1 + (CAST({ONE} AS HUGEINT) * (n + {SMOOTH})) // (sum(n) OVER x + {SMOOTH} * count(*) OVER x) AS q FROM (SELECT lang, term, sum(n) AS n FROM every GROUP BY ALL) WINDOW x AS (PARTITION BY lang)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term GROUP BY ALL),
rows_of AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, p - q FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS "rank"
FROM rows_of QUALIFY part = 'pair' OR "rank" <= {TOP}"""
