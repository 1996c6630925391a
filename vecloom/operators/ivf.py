"""Inverted-file clustering: centroids, assignment, lists, statistics, balanced and overlapping lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.functions.distance import fold_l2, l2
from vecloom.operators import kmeans as kmeans_
from vecloom.operators import matching
from vecloom.operators.topk import BLOCK_CELLS, top_k
from vecloom.sources.shared import table

BLOCK = 65_536
MOST_CENTROID_BYTES = 256 << 20


def first_by_digest(vectors: DataFrame, n: int) -> DataFrame:
    """(ordinal, vec_id, embedding): n vectors in the order of the MD5 of their ids; a bounded sample that SQL can name."""
    picked = vectors.filter("embedding is not null").orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id").limit(n)
    order = W.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id")
    return picked.withColumn("ordinal", F.row_number().over(order) - 1).select("ordinal", "vec_id", "embedding")


def sample_centroids(vectors: DataFrame, nlist: int) -> DataFrame:
    """(cluster_id, centroid): `nlist` vectors of the data as centroids."""
    return first_by_digest(vectors, nlist).select(F.col("ordinal").alias("cluster_id"), F.col("embedding").alias("centroid"))


def centroid_matrix(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) on the driver; an error over MOST_CENTROID_BYTES, which is the bound of what is broadcast."""
    rows = centroids.orderBy("cluster_id").select("cluster_id", "centroid").collect()
    matrix = np.array([r["centroid"] for r in rows], np.float32)
    if matrix.nbytes > MOST_CENTROID_BYTES:
        raise ValueError(f"centroids over {MOST_CENTROID_BYTES} bytes")
    return np.array([r["cluster_id"] for r in rows], np.int64), matrix


def nearest(vectors: DataFrame, centroids: DataFrame, k: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, probe_rank, cluster_id, dist): the k nearest centroids of each vector, lowest id on ties. No shuffle."""
    ids, matrix = centroid_matrix(centroids)
    if not 1 <= k <= len(ids):
        raise ValueError(f"between 1 and {len(ids)} clusters can be probed, not {k}")
    shared = vectors.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = shared.value
        for b in batches:
            lists = b.column(1)
            at, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
            step = max(1, (4 << 20) // len(ids))
            for s in range(0, len(b), step):
                rows = np.arange(s, min(s + step, len(b)))
                d = fold_l2(flat[at[rows][:, None] + np.arange(matrix.shape[1])], matrix)
                order = np.argsort(d, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(np.repeat(rows, k))), pa.array(np.tile(np.arange(1, k + 1), len(rows))), pa.array(ids[order].ravel()), pa.array(np.take_along_axis(d, order, 1).ravel())], names=[id_col, "probe_rank", "cluster_id", "dist"])

    kind = vectors.schema[id_col].dataType.simpleString()
    return vectors.select(id_col, vector_col).filter(F.col(vector_col).isNotNull()).mapInArrow(run, f"{id_col} {kind}, probe_rank long, cluster_id long, dist double")


def assign(vectors: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, cluster_id, dist): the nearest centroid of each vector."""
    return nearest(vectors, centroids).drop("probe_rank")


def inverted_lists(labels: DataFrame) -> DataFrame:
    """`labels` (vec_id, cluster_id, ...) with local_idx: the place in the cluster's list, by ascending vec_id.

    Counted by blocks of ids first, so that a cluster with most of the vectors is no single group.
    """
    rows = labels.withColumn("block", F.floor(F.col("vec_id") / BLOCK))
    counts = rows.groupBy("cluster_id", "block").agg(F.count("*").alias("n"))
    before = counts.select("cluster_id", "block", F.coalesce(F.sum("n").over(W.partitionBy("cluster_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = rows.withColumn("r", F.row_number().over(W.partitionBy("cluster_id", "block").orderBy("vec_id")))
    return ranked.join(before, ["cluster_id", "block"]).withColumn("local_idx", (F.col("before") + F.col("r") - 1).cast("long")).drop("block", "r", "before")


def cluster_sizes(labels: DataFrame, centroids: DataFrame) -> DataFrame:
    """(cluster_id, num_vectors), empty clusters included."""
    counts = labels.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return centroids.select("cluster_id").join(counts, "cluster_id", "left").select("cluster_id", F.coalesce("n", F.lit(0)).cast("long").alias("num_vectors"))


def size_stats(sizes: DataFrame) -> DataFrame:
    """One row: clusters, empty ones, least, most and mean size, exact percentiles 1, 50 and 99 (interpolated)."""
    p = lambda q: F.percentile("num_vectors", F.lit(q)).cast("double")
    return sizes.agg(F.count("*").alias("clusters"), F.count_if(F.col("num_vectors") == 0).alias("empty"), F.min("num_vectors").alias("least"), F.max("num_vectors").alias("most"), F.avg("num_vectors").alias("mean"), p(0.01).alias("p01"), p(0.5).alias("p50"), p(0.99).alias("p99"))


def check_labels(labels: DataFrame, nlist: int) -> None:
    """Raises unless all cluster ids lie in 0 .. nlist - 1."""
    if not labels.filter(F.col("cluster_id").isNull() | (F.col("cluster_id") < 0) | (F.col("cluster_id") >= nlist)).isEmpty():
        raise ValueError(f"cluster ids must lie between 0 and {nlist - 1}")


def check_members(members: DataFrame, vectors: DataFrame) -> None:
    """Raises unless all members are vectors."""
    if not members.join(vectors.select("vec_id"), "vec_id", "left_anti").isEmpty():
        raise ValueError("a list has a member that is no vector")


def kmeans(vectors: DataFrame, nlist: int, iterations: int = 10, centroids: DataFrame | None = None, sample_rows: int | None = None, seed: int = 42, min_points: int = 0) -> DataFrame:
    """(cluster_id, centroid) by Lloyd iterations from `centroids`, or from vectors of the data. With `sample_rows` it fits
    on about so many rows, taken by hash. Distances are made in blocks of BLOCK_CELLS, sums per task, and a row per cluster and
    task is shuffled; an empty cluster keeps its centroid, unless `min_points` is 1 or more (`vecloom.operators.kmeans`,
    which also has parallel seeding, mini-batches and restarts)."""
    rows = vectors.filter("embedding is not null")
    if sample_rows:
        rows = table(kmeans_.sampled(rows, sample_rows, seed), "train")
    current = centroids if centroids is not None else sample_centroids(vectors, nlist)
    ids, matrix = centroid_matrix(current)
    matrix, _ = kmeans_.lloyd(rows, matrix, iterations, min_points, BLOCK_CELLS)
    return vectors.sparkSession.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, matrix, strict=True)], "cluster_id long, centroid array<float>")


def _wishes(candidates: DataFrame, seed: int | None) -> DataFrame:
    """(vec_id, turn, c): candidates (vec_id, probe_rank, cluster_id) of each vector in order, and its turn, as a written table."""
    turn = F.col("vec_id") if seed is None else F.xxhash64("vec_id", F.lit(seed))
    lists = candidates.groupBy("vec_id").agg(F.array_sort(F.collect_list(F.struct("probe_rank", "cluster_id"))).alias("c"))
    return table(lists.select(F.col("vec_id").cast("long").alias("vec_id"), turn.cast("long").alias("turn"), F.col("c.cluster_id").cast("array<long>").alias("c")), "wishes")


def balanced(candidates: DataFrame, sizes: int, nlist: int, seed: int | None = 42) -> DataFrame:
    """(vec_id, cluster_id) with at most `sizes` vectors to a cluster, from candidates (vec_id, probe_rank, cluster_id).

    Vectors have a common order (by seeded hash; by id where `seed` is None); each takes the first of its candidates that
    is not full when its turn comes. As all clusters prefer earlier vectors, the stable matching is the same; it is found by
    cutoffs (`vecloom.operators.matching`).

    A vector whose candidates are all full when its turn comes goes to the emptiest cluster, lowest id first, and so takes
    part in all later choices. From the first such vector on, vectors are placed one after the other by one task, which
    holds the clusters' sizes only. With enough candidates a vector there are few of them, or none.
    """
    wishes = _wishes(candidates, seed)
    total = wishes.count()
    if total > nlist * sizes:
        raise ValueError(f"{total} vectors don't fit {nlist} lists of {sizes}")
    placed = matching.chosen(wishes, matching.match(wishes, np.full(nlist, sizes)))
    first = placed.filter("cluster_id is null").agg(F.min(F.struct("turn", "vec_id")).alias("f")).first()["f"]
    if first is None:
        return placed.select("vec_id", "cluster_id")
    late = (F.col("turn") > first["turn"]) | ((F.col("turn") == first["turn"]) & (F.col("vec_id") >= first["vec_id"]))
    settled = placed.filter(~late)
    start = np.zeros(nlist, np.int64)
    for r in settled.groupBy("cluster_id").agg(F.count("*").alias("n")).collect():
        start[r["cluster_id"]] = r["n"]

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = start.copy()
        for b in batches:
            chosen = []
            for wishes in b.column(1).to_pylist():
                c = next((c for c in wishes if counts[c] < sizes), None)
                c = int(np.argmin(counts)) if c is None else c  # a full cluster is never the emptiest
                counts[c] += 1
                chosen.append(c)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chosen, pa.int64())], names=["vec_id", "cluster_id"])

    rest = placed.filter(late).select("vec_id", "c", "turn").repartition(1).sortWithinPartitions("turn", "vec_id").select("vec_id", "c").mapInArrow(in_turn, "vec_id long, cluster_id long")
    return settled.select("vec_id", "cluster_id").unionByName(rest)


def overlap_lists(labels: DataFrame, candidates: DataFrame, target: int, nlist: int, seed: int | None = 42) -> DataFrame:
    """(cluster_id, vec_id, padded): the lists of `labels`, and donated vectors for lists shorter than `target`.

    In seeded order (by id where `seed` is None) each vector is donated at most once, to the first of its candidates that still needs one; a list may
    so hold a vector twice. It is the same matching as in `balanced`, with the lists' needs as sizes. Raises if a list
    stays short.
    """
    sizes = labels.sparkSession.range(nlist).withColumnRenamed("id", "cluster_id").join(labels.groupBy("cluster_id").agg(F.count("*").alias("n")), "cluster_id", "left")
    needs = table(sizes.select("cluster_id", F.greatest(F.lit(0), F.lit(target) - F.coalesce("n", F.lit(0))).alias("need")), "needs")
    wishes = _wishes(candidates.join(needs.filter("need > 0"), "cluster_id"), seed)
    room = np.zeros(nlist, np.int64)
    for r in needs.filter("need > 0").collect():  # a row for each short list
        room[r["cluster_id"]] = r["need"]
    given = matching.chosen(wishes, matching.match(wishes, room)).filter("cluster_id is not null")
    short = needs.join(given.groupBy("cluster_id").agg(F.count("*").alias("got")), "cluster_id", "left").filter(F.coalesce("got", F.lit(0)) < F.col("need"))
    if not short.isEmpty():
        raise ValueError("too few candidates to fill all lists")
    return labels.select("cluster_id", "vec_id", F.lit(False).alias("padded")).unionByName(given.select("cluster_id", "vec_id", F.lit(True).alias("padded")))


def probes(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """(qid, probe_rank, cluster_id, dist): the nprobe nearest clusters of each query (qid, q)."""
    return nearest(queries, centroids, nprobe, "qid", "q")


def probes_by_join(queries: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """`probes` as an ordinary join and window, for centroids too many to broadcast."""
    pairs = queries.crossJoin(centroids).select("qid", "cluster_id", l2(F.col("q"), F.col("centroid")).alias("dist"))
    return top_k(pairs, nprobe, ["qid"], ["dist", "cluster_id"], "probe_rank")
