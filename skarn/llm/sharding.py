"""Sharding by proportional stratified interleaving (operator 1, native).

Rows are shuffled within their source by a seeded hash of the id, and each gets its fractional rank
(2 * rank - 1) / (2 * rows of the source).  Sorting all rows by that fraction interleaves the sources in
proportion, so any contiguous run matches the mixture; the sequence is cut into ``n_shards`` runs.  Law
``rows``: shard sizes in rows differ by at most one.

No rank is taken over a whole source or table in one task.  Ranks come from counts: rows fall into
``buckets`` hash (then fraction) buckets, a prefix sum over the bucket counts gives each bucket its first
rank, and only rows of one bucket are ordered together.  A source of a third of all rows spreads over all
buckets.  The text is read once, for its size and checksum; only narrow rows are shuffled.

A null source is a source of its own.  A null text has size 16 and the checksum of no bytes (0).  Null and
repeated ids are ordered by hash and checksum; rows equal in all of these are interchangeable.  An empty
table gives no rows.  With fewer rows than shards, the later shards stay empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAW = "rows"
BUCKETS = 4096


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list[Column], buckets: DataFrame, name: str) -> DataFrame:
    """Adds the 1-based rank of each row within group by (bucket, order), from the buckets' first ranks."""
    w = Window.partitionBy(*group, bucket).orderBy(*order)
    return rows.join(buckets, [*group, bucket]).withColumn(name, F.col("before") + F.row_number().over(w)).drop("before")


def interleave(docs: DataFrame, n_shards: int = 40, seed: int = 1, buckets: int = BUCKETS, source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, source, sequence (0-based place in the interleaving), shard and slot of every row."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        F.coalesce(docs[source_col].cast("string"), F.lit("\u0000none")).alias("source"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        # rows without an id draw by their text, so that many of them do not share a bucket
        F.md5(F.concat(F.lit(f"{seed}-"), F.coalesce(docs["doc_id"].cast("string"), F.concat(F.lit("null-"), F.crc32(text).cast("string"), F.lit("-"), F.octet_length(text).cast("string"))))).alias("draw"),
    ).withColumn("bucket", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.lit(buckets)).cast("int"))
    # order inside a bucket must follow the bucket first: rank by (bucket, draw, ...)
    counts = rows.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    upto = Window.partitionBy("source").orderBy("bucket")
    first = counts.select("source", "bucket", (F.sum("n").over(upto) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("source")).alias("of"))
    order = [F.col("draw"), F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    ranked = _ranked(rows, ["source"], "bucket", order, first, "rank").withColumn("frac", (2 * F.col("rank") - 1) / (2 * F.col("of"))).drop("bucket")
    # second pass: the place of every fraction in the whole table
    binned = ranked.withColumn("bin", F.floor(F.col("frac") * buckets).cast("int")).withColumn("all", F.lit(0))
    bins = binned.groupBy("all", "bin").agg(F.count("*").alias("n"))
    start = bins.select("all", "bin", (F.sum("n").over(Window.partitionBy("all").orderBy("bin")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy("all")).alias("total"))
    placed = _ranked(binned, ["all"], "bin", [F.col("frac"), F.col("source"), *order], start, "place").withColumn("sequence", F.col("place") - 1)
    # shard k holds places [ceil(k * total / n), ceil((k + 1) * total / n))
    shard = F.expr(f"(sequence * {n_shards}) div total")
    begin = F.expr(f"(((sequence * {n_shards}) div total) * total + {n_shards - 1}) div {n_shards}")
    return placed.select("doc_id", "size", "text_crc32", "source", "sequence", shard.cast("int").alias("shard"), (F.col("sequence") - begin).cast("long").alias("slot"))


def sharding(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Digest of interleave() under the contract's names."""
    out = interleave(docs, n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source", "sequence")


#: The same, for DuckDB; its build has no crc32, so the checksum is folded over the bytes bit by bit.
ORACLE = """
WITH table_ AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c
    FROM (SELECT unnest(range(256))::BIGINT AS i))),
rows_ AS (
  SELECT doc_id, coalesce(source, chr(0) || 'none') AS source, strlen(coalesce(text, '')) + 16 AS size, coalesce(text, '') AS text,
         md5('1-' || coalesce(doc_id::VARCHAR, 'null')) AS draw FROM documents),
bytes_ AS (
  SELECT *, ('0x' || substr(draw, 1, 8))::BIGINT % 4096 AS bucket,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)),
             lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS text_crc32 FROM rows_, table_),
ranked AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY source ORDER BY bucket, draw, doc_id) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY source))::DOUBLE AS frac FROM bytes_),
placed AS (
  SELECT *, row_number() OVER (ORDER BY frac, source, draw, doc_id) - 1 AS sequence, count(*) OVER () AS total FROM ranked)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, ((sequence * 40) // total)::INTEGER AS shard,
       sequence - ((((sequence * 40) // total) * total + 39) // 40) AS slot, NULL::INTEGER AS grown_shard, source, sequence
FROM placed
"""
