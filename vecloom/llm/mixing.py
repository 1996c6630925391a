"""Mixing sources to target weights by systematic sampling, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.llm.storage import table

SEED = "mix-1"
MOST_COPIES = 3
WORDS = r"[^\x20\x09-\x0D]+"
BLOCK = 4096  # ids to a block of the prefix sums


def _size(text_col: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """(source, source_size, target) from (source, source_size). Sources by code point, null last, weigh 1, 2, 3, 1, ...;
    each gets least(weight * level, most * source_size), at the one level that shares out all sizes.

    Sorted by the level at which it stops, a source stops if the level that would serve it and all behind it is higher.
    One row per source goes through the window.
    """
    weighed = sizes.withColumn("weight", ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("double")).withColumn("most", (F.col("source_size") * most).cast("double"))
    order = [F.col("most") / F.col("weight"), F.col("source").asc_nulls_last()]
    before = W.orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    everything = W.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    leveled = weighed.withColumn("level", level).withColumn("stops", F.col("most") <= F.col("weight") * F.col("level"))
    final = F.min(F.when(~F.col("stops"), F.struct(F.col("most") / F.col("weight"), F.col("level").alias("level")))).over(everything)["level"]
    return leveled.withColumn("final", final).select("source", "source_size", F.when(F.col("stops"), F.col("most")).otherwise(F.col("weight") * F.col("final")).alias("target"))


def _plan(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """One row per distinct (source, size, id, row hash): n rows like it, `start`, the number of rows before it in its
    source, and expected copies per row.

    The order in a source is by size, then id, so that any stretch of it holds texts of all but equal size. Ranks come
    from counts by size, by block of ids within a size, and within a block: no step sorts a whole source.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(F.col(source_col).alias("source"), _size(text_col).alias("size"), F.col(id_col).alias("id"), F.xxhash64(*columns).alias("row_hash"))
    units = table(rows.groupBy("source", "size", "id", "row_hash").agg(F.count("*").alias("n")), "units")
    sized = units.groupBy("source", "size").agg(F.sum("n").alias("n"))
    goal = targets(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    start = lambda *by: F.coalesce(F.sum("n").over(W.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    by_size = sized.withColumn("size_start", start("source", F.col("size"))).drop("n")
    units = units.withColumn("block", F.floor(F.col("id") / BLOCK))
    by_block = units.groupBy("source", "size", "block").agg(F.sum("n").alias("n")).withColumn("block_start", start("source", "size", F.col("block").asc_nulls_first())).drop("n")
    inner = W.partitionBy("source", "size", "block").orderBy(F.col("id").asc_nulls_first(), "row_hash").rowsBetween(W.unboundedPreceding, -1)
    placed = units.withColumn("unit_start", F.coalesce(F.sum("n").over(inner), F.lit(0)))
    same = lambda a, b, *names: [a[x].eqNullSafe(b[x]) for x in names]
    starts = by_block.join(by_size, same(by_block, by_size, "source", "size")).select(by_block["source"], by_block["size"], by_block["block"], (F.col("size_start") + F.col("block_start")).alias("start"))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    goal = goal.select("*", offset.alias("offset"), F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST_COPIES)), F.col("target") / F.col("source_size"))).otherwise(0.0).alias("ratio"))
    starts = starts.join(goal, same(starts, goal, "source")).drop(goal["source"])
    joined = placed.join(starts, same(placed, starts, "source", "size", "block"))
    return joined.select(placed["source"], placed["size"], "id", "row_hash", "n", (F.col("start") + F.col("unit_start")).alias("start"), "source_size", "target", "ratio", "offset")


def _crossed(first: Column, n: Column | int) -> Column:
    """Integer boundaries that n rows from rank `first` on cross."""
    at = lambda x: F.floor(F.col("offset") + x * F.col("ratio"))
    return (at(first + n) - at(first)).cast("long")


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """One row per input row: the id, size (words), source_size, target (its source's), copies and taken (words).

    Every row of a source is expected target / source_size times. Expected copies are summed from row to row, from one
    random offset per source (of the seed and the source's name), and a row is taken once for each integer crossed.
    A null text has size 0; null sources are one source, last; a null id sorts first in its size; repeated rows are
    numbered one after the other; an empty table gives no rows. Ids are integers. Reruns agree.
    """
    rows = _plan(docs, id_col, text_col, source_col, seed).withColumn("rank", F.explode(F.expr("sequence(start, start + n - 1)")))
    copies = rows.withColumn("copies", _crossed(F.col("rank"), 1))
    return copies.select(F.col("id").alias(id_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = SEED) -> DataFrame:
    """The rows of the mix: each row of `docs`, all columns as they are, as many times as `mix_report` takes it.

    Rows meet their numbers of copies by a merge join whatever their number, so the plan and its one shuffle of texts are
    the same for small and large tables. Nulls, repeated rows and empty tables as in `mix_report`; of rows alike in
    every column one stands for all. Other columns may have any name.
    """
    plan = table(_plan(docs, id_col, text_col, source_col, seed).select("source", "size", "id", "row_hash", "n", _crossed(F.col("start"), F.col("n")).alias("copies")), "plan")
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("row_hash"))
    twin = plan.filter("n > 1").select("row_hash", F.struct("source", "size", "id").alias("twin")).distinct()
    wanted = plan.filter("copies > 0").select("row_hash", "id", "copies")
    if not twin.isEmpty():  # rows alike in every column: one of them stands for all
        alike = tagged.join(twin.select("row_hash").distinct(), "row_hash", "left_semi").dropDuplicates()
        tagged = tagged.join(twin.select("row_hash").distinct(), "row_hash", "left_anti").unionByName(alike)
    kept = tagged.join(wanted.hint("merge"), (tagged["row_hash"] == wanted["row_hash"]) & tagged[f"row.{id_col}"].eqNullSafe(wanted["id"]))
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


ORACLE_SQL = rf"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, ({MOST_COPIES} * source_size)::DOUBLE AS most FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(most) OVER b, 0.0))
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER b, 0.0)) AS level FROM w
  WINDOW b AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, most <= weight * level AS stops, min(CASE WHEN NOT (most <= weight * level) THEN most / weight END) OVER () AS edge FROM l),
g AS (SELECT source, source_size, CASE WHEN stops THEN most ELSE weight * (SELECT min(level) FROM f x WHERE NOT x.stops AND x.most / x.weight = f.edge) END AS target FROM f),
r AS (SELECT d.*, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN least({MOST_COPIES}.0::DOUBLE, g.target / g.source_size) ELSE 0.0::DOUBLE END AS ratio,
    row_number() OVER (PARTITION BY d.source ORDER BY size, doc_id NULLS FIRST) - 1 AS k,
    ('0x' || substr(md5('{SEED}:' || coalesce(d.source, '')), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
c AS (SELECT *, (floor(u + (k + 1)::DOUBLE * ratio) - floor(u + k::DOUBLE * ratio))::BIGINT AS copies FROM r)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c"""
