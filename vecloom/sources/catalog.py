"""Saving and loading an index as Parquet tables, and reading as little of it as a search needs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.distance import segment

SLOT_BITS = 32


def slot(cluster_id: Column, local_idx: Column) -> Column:
    """One number for a place in the lists."""
    return F.shiftleft(cluster_id.cast("long"), SLOT_BITS) + local_idx.cast("long")


def cluster_of(slot_: Column) -> Column:
    return F.shiftright(slot_, SLOT_BITS)


def place_of(slot_: Column) -> Column:
    return slot_.bitwiseAND(F.lit((1 << SLOT_BITS) - 1))


@dataclass
class Index:
    """lists (cluster_id, local_idx, vec_id, embedding), centroids, clusters (sizes and extents), and optional codes (vec_id,
    codes), codebooks and graph of the centroids (`vecloom.operators.graph`). A saved index has lists that are partitioned by `buckets` of clusters, with the embedding as it
    is or cut into columns of `shard_dims`, with `slot`, and with codes in the lists."""

    lists: DataFrame
    centroids: DataFrame
    clusters: DataFrame
    codes: DataFrame | None = None
    codebooks: DataFrame | None = None
    graph: DataFrame | None = None
    buckets: int = 0
    shard_dims: tuple[int, ...] = ()

    def _column(self, name: str) -> Column:
        """A column of the lists, made of what is stored: slot, embedding, codes, or `seg:first:last` of dimensions."""
        have = set(self.lists.columns)
        if name == "slot" and name not in have:
            return slot(F.col("cluster_id"), F.col("local_idx")).alias(name)
        if name == "embedding" and name not in have:
            return F.concat(*[f"seg{i}" for i in range(len(self.shard_dims))]).alias(name)
        if name.startswith("seg:"):
            first, last = (int(x) for x in name.split(":")[1:])
            at = 0
            for i, n in enumerate(self.shard_dims):
                if (at, at + n) == (first, last):
                    return F.col(f"seg{i}").alias("seg")
                at += n
            whole = F.col("embedding") if "embedding" in have else F.concat(*[f"seg{i}" for i in range(len(self.shard_dims))])
            return segment(whole, first, last - first).alias("seg")
        return F.col(name)

    def bucket_of(self, cluster_id: Column) -> Column:
        return F.pmod(cluster_id, F.lit(max(1, self.buckets))).cast("int")

    def entries(self, *columns: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """Columns of the lists. Of a saved index only the files of those `buckets` are read, and only what the columns need."""
        rows = self.lists
        if self.buckets and buckets is not None:
            rows = rows.filter(F.col("bucket").isin(sorted(set(buckets))))
        if "codes" in columns and "codes" not in rows.columns:
            if self.codes is None:
                raise ValueError("the index has no codes")
            rows = rows.join(self.codes, "vec_id")
        return rows.select(*[self._column(c) for c in columns])

    def tables(self) -> dict[str, DataFrame]:
        return {k: v for k in ("centroids", "clusters", "codebooks", "graph") if (v := getattr(self, k)) is not None}


def save(index: Index, path: str, shard_dims: Sequence[int] | None = None, buckets: int = 64) -> None:
    """Lists are partitioned by a bucket of cluster_id and sorted by cluster_id and local_idx. With `shard_dims` each shard is
    a column seg0, seg1, ... of its own, so a stage reads only its own. Codes are stored beside their vectors."""
    rows = index.lists
    if index.codes is not None:
        rows = rows.join(index.codes, "vec_id")
    names = ["cluster_id", "local_idx", "vec_id", slot(F.col("cluster_id"), F.col("local_idx")).alias("slot")]
    offsets = [sum(shard_dims[:i]) for i in range(len(shard_dims))] if shard_dims else []
    vector = [segment(F.col("embedding"), o, n).alias(f"seg{i}") for i, (o, n) in enumerate(zip(offsets, shard_dims or (), strict=True))] or ["embedding"]
    codes = ["codes"] if index.codes is not None else []
    rows = rows.select(*names, *vector, *codes, F.pmod("cluster_id", F.lit(buckets)).cast("int").alias("bucket"))
    # ranges of (cluster, place): a cluster with most of the vectors goes to several files
    rows.repartitionByRange("bucket", "cluster_id", "local_idx").sortWithinPartitions("bucket", "cluster_id", "local_idx").write.partitionBy("bucket").parquet(f"{path}/lists")
    for name, df in index.tables().items():
        df.write.parquet(f"{path}/{name}")
    spark = index.lists.sparkSession
    spark.createDataFrame([(buckets, list(shard_dims or ()))], "buckets int, shard_dims array<int>").coalesce(1).write.parquet(f"{path}/layout")


def load(spark: SparkSession, path: str, check: bool = True) -> Index:
    """An index as it was saved. `check`: the lists have as many entries as the clusters say (read from file footers)."""
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    lists, clusters, layout = read("lists"), read("clusters"), read("layout").first()
    if check:
        want = clusters.agg(F.sum("num_vectors").alias("n")).first()["n"] or 0
        if lists.count() != want:
            raise ValueError(f"the lists should have {want} entries")
    optional = {}
    for name in ("codebooks", "graph"):
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        if jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
            optional[name] = read(name)
    return Index(lists, read("centroids"), clusters, buckets=layout["buckets"], shard_dims=tuple(layout["shard_dims"]), **optional)
