"""Per-query distance thresholds for the staged search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.operators.topk import exact_knn

FALLBACK = 1e6
SAMPLE_ROWS = 10_000
NEIGHBOURS = 10
MOST_CENTROID_RANK = 50


def usable(value: Column, fallback: float = FALLBACK) -> Column:
    """The value, or the fallback where it is null, not finite or not positive."""
    bad = value.isNull() | F.isnan(value) | (value <= 0) | (value == float("inf"))
    return F.when(bad, F.lit(fallback)).otherwise(value)


def prune_sample(lists: DataFrame, extents: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """Entries of the lists at positions floor(i * total / s) of list order, i = 0 .. s - 1, s the lesser of total and `most`.

    A position is kept if an i leads to it, which is arithmetic on the position alone: no join with the positions.
    """
    total = extents.agg(F.sum("num_vectors").cast("long").alias("total"))
    placed = lists.join(extents.select("cluster_id", "sorted_id_base"), "cluster_id").crossJoin(F.broadcast(total))
    rows = placed.withColumn("pos", F.col("sorted_id_base") + F.col("local_idx")).withColumn("s", F.least(F.col("total"), F.lit(most)))
    i = F.expr("(pos * s + total - 1) div total")
    return rows.withColumn("i", i).filter(F.expr("i < s and (i * total) div s = pos")).drop("s", "total", "sorted_id_base")


def sampled(sample: DataFrame, queries: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(qid, threshold): distance to the k-th nearest vector of the sample; the fallback if it has fewer."""
    nth = exact_knn(sample, queries, k).filter(F.col("rank") == k).select("qid", "dist")
    return queries.select("qid").join(nth, "qid", "left").select("qid", usable(F.col("dist")).alias("threshold"))


def centroid(probes: DataFrame, nprobe: int) -> DataFrame:
    """(qid, threshold): distance of the least(nprobe, 50)-th nearest cluster."""
    return probes.filter(F.col("probe_rank") == min(nprobe, MOST_CENTROID_RANK)).select("qid", usable(F.col("dist")).alias("threshold"))
