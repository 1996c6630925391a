"""Placement of lists on disks, as ordinary columns: shards, packing, extents, greedy placement, replicas, batches, reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECTOR = 4096


def shard_plan(dim: int, shard_dims: Sequence[int], sector: int = SECTOR) -> list[dict]:
    """Offset, dimensions, bytes and vectors per sector of each shard; the dimensions must add up."""
    if not 1 <= len(shard_dims) <= 4 or min(shard_dims) < 1 or sum(shard_dims) != dim:
        raise ValueError(f"one to four shards must add up to {dim} dimensions")
    plan, offset = [], 0
    for shard, n in enumerate(shard_dims):
        if sector // (4 * n) == 0:
            raise ValueError(f"a vector of shard {shard} doesn't fit a sector")
        plan.append({"shard": shard, "offset": offset, "dim": n, "bytes": 4 * n, "per_sector": sector // (4 * n)})
        offset += n
    return plan


def disk_shards(disks: Sequence[int], n_shards: int) -> list[tuple[int, int]]:
    """(disk, shard) of a map of disks; every shard needs a disk."""
    if set(range(n_shards)) - set(disks):
        raise ValueError("every shard needs a disk")
    if set(disks) - set(range(n_shards)):
        raise ValueError("a disk has no such shard")
    return list(enumerate(disks))


def stage_disks(counts: Sequence[int]) -> list[tuple[int, int]]:
    """(stage, disk): consecutive disks for each stage, four in all at most."""
    if min(counts) < 1 or sum(counts) > 4:
        raise ValueError("each stage needs a disk, and there are four")
    return [(stage, sum(counts[:stage]) + i) for stage, n in enumerate(counts) for i in range(n)]


def extents(sizes: DataFrame, per_sector: Sequence[int], base: int = 0) -> DataFrame:
    """`sizes` (cluster_id, num_vectors) with num_lbas, start_lba and sorted_id_base: clusters follow one another in order
    of their ids. One row per cluster goes through the window."""
    lbas = F.greatest(*[F.ceil(F.col("num_vectors") / n) for n in per_sector], F.lit(0)).cast("long")
    before = W.orderBy("cluster_id").rowsBetween(W.unboundedPreceding, -1)
    rows = sizes.withColumn("num_lbas", lbas)
    return rows.withColumn("start_lba", base + F.coalesce(F.sum("num_lbas").over(before), F.lit(0))).withColumn("sorted_id_base", F.coalesce(F.sum("num_vectors").over(before), F.lit(0)))


def packed(lists: DataFrame, placed: DataFrame, per_sector: int) -> DataFrame:
    """`lists` (cluster_id, local_idx, vec_id) with bundle, lane and lba of each vector."""
    where = lists.join(placed.select("cluster_id", "start_lba"), "cluster_id")
    bundle = F.floor(F.col("local_idx") / per_sector)
    return where.select("cluster_id", "local_idx", "vec_id", bundle.alias("bundle"), F.pmod("local_idx", F.lit(per_sector)).cast("long").alias("lane"), (F.col("start_lba") + bundle).alias("lba"))


def greedy_disks(sizes: DataFrame, disks: int = 4) -> DataFrame:
    """(cluster_id, disk_id): clusters in order of their ids, each to the disk with the fewest vectors so far, lowest disk on
    ties. A fold over one row per cluster; it depends on every cluster before, so it runs in one task."""
    items = sizes.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "num_vectors"))).alias("items"))
    zero = F.struct(F.array(*[F.lit(0).cast("long")] * disks).alias("load"), F.array().cast("array<struct<cluster_id:bigint,disk_id:int>>").alias("out"))

    def step(state, item):
        least = F.array_min(state["load"])
        disk = F.array_position(state["load"], least).cast("int") - 1
        load = F.transform(state["load"], lambda v, i: F.when(i == disk, v + item["num_vectors"]).otherwise(v))
        return F.struct(load.alias("load"), F.concat(state["out"], F.array(F.struct(item["cluster_id"].cast("long").alias("cluster_id"), disk.alias("disk_id")))).alias("out"))

    return items.select(F.explode(F.aggregate("items", zero, step)["out"]).alias("o")).select("o.cluster_id", "o.disk_id")


def pq_regions(sizes: DataFrame, placement: DataFrame, m: int, dim: int, base: int = 0, sector: int = SECTOR) -> DataFrame:
    """Codes first, raw vectors behind them, on each disk: start and length in sectors of both for each cluster."""
    per_code, per_raw = sector // m, sector // (4 * dim)
    if not per_code or not per_raw:
        raise ValueError("a vector doesn't fit a sector")
    rows = sizes.join(placement, "cluster_id").withColumn("pq_lbas", F.ceil(F.col("num_vectors") / per_code)).withColumn("raw_lbas", F.ceil(F.col("num_vectors") / per_raw))
    before = W.partitionBy("disk_id").orderBy("cluster_id").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy("disk_id")
    codes = base + F.coalesce(F.sum("pq_lbas").over(before), F.lit(0))
    raw = base + F.sum("pq_lbas").over(everything) + F.coalesce(F.sum("raw_lbas").over(before), F.lit(0))
    return rows.select("cluster_id", "disk_id", "pq_lbas", codes.alias("pq_start"), "raw_lbas", raw.alias("raw_start"))


def replicas(placed: DataFrame, disks: Sequence[int] = (1, 2, 3), base: int = 0) -> DataFrame:
    """`placed` extents on disk 0, and those of a copy on each other disk, which begins where all extents end."""
    end = F.max(F.col("start_lba") + F.col("num_lbas")).over(W.partitionBy())
    rows = placed.withColumn("replica_base", F.greatest(end, F.lit(base)))
    home = rows.select("cluster_id", F.lit(0).alias("disk_id"), F.col("start_lba").alias("lba"), "num_lbas")
    copies = rows.withColumn("disk_id", F.explode(F.array(*[F.lit(d) for d in disks]))).select("cluster_id", "disk_id", (F.col("replica_base") + F.col("start_lba") - base).alias("lba"), "num_lbas")
    return home.unionByName(copies)


def replica_of(queries: DataFrame, batch: int = 32, disks: int = 4) -> DataFrame:
    """(qid, disk_id): runs of `batch` queries go round the replicas."""
    return queries.select("qid", F.pmod(F.floor((F.col("qid") - 1) / batch), F.lit(disks)).cast("int").alias("disk_id"))


def batch_slices(sizes: DataFrame, batch: int = 256) -> DataFrame:
    """(cluster_id, batch, first_idx, n): a cluster's vectors in batches."""
    rows = sizes.filter("num_vectors > 0").withColumn("batch", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("num_vectors") / batch) - 1)))
    return rows.select("cluster_id", "batch", (F.col("batch") * batch).alias("first_idx"), F.least(F.lit(batch), F.col("num_vectors") - F.col("batch") * batch).cast("long").alias("n"))


def read_groups(hits: DataFrame) -> DataFrame:
    """(qid, disk_id, lba, n): candidates that one read of a sector serves."""
    return hits.groupBy("qid", "disk_id", "lba").agg(F.count("*").alias("n"))


def read_runs(bundles: DataFrame, gap: int = 1, most: int = 256) -> DataFrame:
    """(qid, cluster_id, first, last): reads for the wanted bundles (qid, cluster_id, batch, bundle).

    A read goes on while the next bundle leaves a gap of at most `gap` unwanted ones and its span stays within `most`. A
    fold over one batch's bundles, of which there are 256 at most.
    """
    if not 0 <= gap <= 256 or most < 1:
        raise ValueError("gap lies between 0 and 256, most is positive")
    lists = bundles.groupBy("qid", "cluster_id", "batch").agg(F.array_sort(F.collect_set("bundle")).alias("b"))
    zero = F.array().cast("array<struct<first:bigint,last:bigint>>")

    def step(runs, b):
        b = b.cast("long")
        last = F.element_at(runs, -1)
        goes = (F.size(runs) > 0) & (b - F.get(runs, F.size(runs) - 1)["last"] - 1 <= gap) & (b - F.get(runs, F.size(runs) - 1)["first"] + 1 <= most)
        new = F.array(F.struct(b.alias("first"), b.alias("last")))
        longer = F.array(F.struct(last["first"].alias("first"), b.alias("last")))
        return F.when(goes, F.concat(F.slice(runs, F.lit(1), F.greatest(F.size(runs) - 1, F.lit(0))), longer)).otherwise(F.concat(runs, new))

    return lists.select("qid", "cluster_id", "batch", F.explode(F.aggregate("b", zero, step)).alias("r")).select("qid", "cluster_id", "batch", "r.first", "r.last")
