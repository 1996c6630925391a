"""Sharding by extendible hashing, in DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.storage import table

LIMIT_BYTES = 16 << 20
HASH_BITS = 60
SLACK_BITS = 5  # a round looks so many bits further than even splitting would need


def _key(id_col: str, text_col: str) -> Column:
    """60 bits of MD5 of the id's text; of the text itself where the id is null."""
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.coalesce(text_col, F.lit(""))))
    return F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long")


def _directory(sizes: DataFrame, depth: int, limit: int) -> DataFrame:
    """For each prefix of `depth` bits that occurs: the shortest shard prefix of it that fits the limit (null: none)."""
    cells = sizes.groupBy(F.shiftright("bits", HASH_BITS - depth).alias("cell")).agg(F.sum("n_bytes").alias("cell_bytes"))
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)"))
    buckets = levels.groupBy("depth", "prefix").agg(F.sum("cell_bytes").alias("shard_bytes"))
    found = levels.join(buckets, ["depth", "prefix"]).groupBy("cell")
    return found.agg(F.min(F.when(F.col("shard_bytes") <= limit, F.struct("depth", "prefix", "shard_bytes"))).alias("shard"))


def _pages(rest: DataFrame, limit: int) -> DataFrame:
    """Overflow pages for rows that share all bits: rows of one size at a time, as many to a page as fit, one at least.
    Rows are numbered within their input partition and offset by the partitions before, so that no group lies in one
    task."""
    rest = table(rest.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "pages")
    by = ["bits", "n_bytes"]
    counts = rest.groupBy(*by, "part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    rank = F.col("before") + F.row_number().over(W.partitionBy(*by, "part").orderBy("at")) - 1
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))))
    paged = rest.join(before, [*by, "part"]).withColumn("page", F.floor(rank / per_page).cast("long")).drop("part", "at", "before")
    sums = paged.groupBy(*by, "page").agg(F.sum("n_bytes").alias("shard_bytes"))
    return paged.join(sums, [*by, "page"])


def extendible_shards(docs: DataFrame, limit_bytes: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, n_bytes of the text, its shard as a string of hash-prefix bits, its depth, its
    overflow page, the shard's bytes, and whether a single text is over the limit.

    A bucket splits on one more bit only while it is over the limit, so every shard is the shortest prefix that fits.
    The directory is built from sums by prefix; only ids, hashes and sizes move, never texts. Rows that share all 60
    bits (the same id again) go to overflow pages `page` 0, 1, ... of the full prefix, by size; a text longer than the
    limit has a page of its own. A null id is hashed by its text; a null text has 0 bytes; an empty table gives no rows.
    """
    keyed = docs.select(F.col(id_col), _key(id_col, text_col).alias("bits"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    total = docs.select(F.sum(F.octet_length(text_col)).alias("s")).first()["s"] or 0
    depth = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit_bytes)))) + SLACK_BITS)
    out, rest = None, keyed
    while True:
        directory = table(_directory(rest, depth, limit_bytes), "directory")
        cell = F.shiftright("bits", HASH_BITS - depth)
        found = rest.withColumn("cell", cell).join(directory, "cell")
        done = found.filter("shard is not null").select(id_col, "n_bytes", F.col("shard.depth").alias("depth"), F.col("shard.prefix").alias("prefix"), F.lit(0).cast("long").alias("page"), F.col("shard.shard_bytes").alias("shard_bytes"))
        out = done if out is None else out.unionByName(done)
        if directory.filter("shard is null").isEmpty():
            break
        rest = found.filter("shard is null").select(id_col, "bits", "n_bytes")
        if depth == HASH_BITS:
            pages = _pages(rest, limit_bytes)
            out = out.unionByName(pages.select(id_col, "n_bytes", F.lit(HASH_BITS).alias("depth"), F.col("bits").alias("prefix"), "page", "shard_bytes"))
            break
        depth = min(HASH_BITS, depth + 2 * SLACK_BITS)
    shard = F.when(F.col("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return out.select(id_col, "n_bytes", shard.alias("shard"), F.col("depth").cast("int").alias("depth"), "page", "shard_bytes", (F.col("n_bytes") > limit_bytes).alias("oversized"))


# Splits down to 24 bits, which is more than the given tables need.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || coalesce(text, ''))), 1, 15))::BIGINT AS bits FROM documents),
levels AS (SELECT range::INT AS depth FROM range(0, 25)),
buckets AS (SELECT depth, bits >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM d, levels GROUP BY ALL),
fits AS (SELECT d.*, b.depth, b.prefix, b.shard_bytes,
           row_number() OVER (PARTITION BY d.bits, d.doc_id ORDER BY b.depth) AS r
         FROM d, levels l JOIN buckets b ON b.depth = l.depth AND b.prefix = d.bits >> (60 - l.depth) WHERE b.shard_bytes <= {LIMIT_BYTES})
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 60) || bin(prefix), depth) END AS shard,
  depth::INT AS depth, 0::BIGINT AS page, shard_bytes, n_bytes > {LIMIT_BYTES} AS oversized FROM fits WHERE r = 1"""
