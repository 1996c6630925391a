"""Connected components of a graph given as a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.storage import discard, table


def _sum(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of `links` (a, b): the smallest node reachable.

    Each round links all larger neighbours of a node to the smallest one, then all smaller ones; links turn into stars in
    a number of rounds that grows with the logarithm of the number of nodes. Every round is a table in the shared
    folder, which replaces the one before. Minima are aggregated before they are joined back, so a node with very many links is no unbounded group.
    Null ends and links of a node with itself don't count; an empty table gives no rows.
    """
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and u != v").distinct()
    now = table(pairs, "links")
    state = _sum(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        hang = large.join(small, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, now = now, table(hang.unionByName(small.select("u", F.col("m").alias("v"))).distinct(), "links")
        discard(last)
        before, state = state, _sum(now)
        if state == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
