"""Bounded top-k and recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.functions.distance import pair_l2, product_l2, where

BLOCK_CELLS = 4 << 20  # distances held at a time by the Arrow kernel
MOST_QUERY_BYTES = 64 << 20
TILE = 1024  # rows and queries that are compared by one matrix product
NONE = np.iinfo(np.int64).max
PART_ROWS = 1 << 16  # vectors of each side that a group of `exact_knn_join` holds, about


def top_k(rows: DataFrame, k: int, by: list[str], order: list[str], rank: str = "rank") -> DataFrame:
    """The k first rows of each group, with their rank. Spark limits each partition to k rows a group before it shuffles."""
    return rows.withColumn(rank, F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def tiles(n: int, m: int) -> Iterator[tuple[slice, slice]]:
    """n rows and m queries in blocks of at most TILE * TILE cells."""
    rows = min(n, TILE)
    step = max(1, TILE * TILE // max(1, rows))
    for r in range(0, n, max(1, rows)):
        for s in range(0, m, step):
            yield slice(r, min(r + rows, n)), slice(s, min(s + step, m))


class Nearest:
    """The k least (distance, id) of each query so far, with the slot of each."""

    def __init__(self, n: int, k: int):
        self.d, self.i, self.s = np.full((n, k), np.nan), np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def likely(self, d: np.ndarray, asks: np.ndarray, slack: np.ndarray | float = 0.0) -> np.ndarray:
        """Which of the distances d (rows, asks), known up to `slack`, may be among the k least. NaN may."""
        k, slack = self.d.shape[1], np.broadcast_to(slack, len(asks))
        out = ~(d > self.d[asks, k - 1] + slack)
        many = np.flatnonzero(out.sum(axis=0) > 4 * k) if len(d) > k else []
        if len(many):
            some = d[:, many]
            out[:, many] &= ~(some > np.partition(some, k - 1, axis=0)[k - 1] + 2 * slack[many])
        return out

    def add(self, at: np.ndarray, d: np.ndarray, ids: np.ndarray, slots: np.ndarray) -> None:
        """Exact distances d of entries (ids, slots) to the queries `at`."""
        if not len(at):
            return
        who, k = np.unique(at), self.d.shape[1]
        q, d = np.concatenate([np.repeat(who, k), at]), np.concatenate([self.d[who].ravel(), d])
        i, s = np.concatenate([self.i[who].ravel(), ids]), np.concatenate([self.s[who].ravel(), slots])
        order = np.lexsort((i, d, q))
        first = np.searchsorted(q[order], who)
        order = order[first[:, None] + np.arange(k)]
        self.d[who], self.i[who], self.s[who] = d[order], i[order], s[order]

    def compare(self, x: np.ndarray, ids: np.ndarray, slots: np.ndarray, q: np.ndarray, asks: np.ndarray) -> None:
        """The rows of x against q[asks], by tiles; sums over the dimensions are made of those that may be among the k least."""
        for r, s in tiles(len(x), len(asks)):
            mine, here = asks[s], x[r].astype(np.float64)
            d, slack = product_l2(here, q[mine])
            row, at = where(self.likely(d, mine, slack))
            self.add(mine[at], pair_l2(here, q, row, mine[at]), ids[r][row], slots[r][row])

    def rows(self, qid: np.ndarray) -> pa.RecordBatch:
        at, place = np.nonzero(self.i != NONE)
        return pa.RecordBatch.from_arrays([pa.array(qid[at]), pa.array(self.s[at, place]), pa.array(self.i[at, place]), pa.array(self.d[at, place])], names=["qid", "slot", "vec_id", "dist"])


def exact_knn(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, rank, vec_id, dist): the k nearest vectors of `base` (vec_id, embedding) to each query (qid, q).

    A query set against all rows: queries go to every task, in batches of at most MOST_QUERY_BYTES, and each task keeps k
    rows per query, block by block; so a partition sends k rows a query to the shuffle, however many it reads. Ties go
    to the lower vec_id. Null vectors have no distance.
    """
    spark = base.sparkSession
    parts = None
    for qid, q in query_batches(queries):
        shared = spark.sparkContext.broadcast((qid, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qid, q = shared.value
            best, wide, asks = Nearest(len(qid), k), q.astype(np.float64), np.arange(len(qid))
            for b in batches:
                ids, x = _rows(b.column(0), b.column(1), q.shape[1])
                best.compare(x, ids, np.zeros(len(ids), np.int64), wide, asks)
            yield best.rows(qid).select(["qid", "vec_id", "dist"])

        found = base.select("vec_id", "embedding").filter("embedding is not null").mapInArrow(run, "qid long, vec_id long, dist double")
        parts = found if parts is None else parts.unionByName(found)
    if parts is None:
        return spark.createDataFrame([], "qid long, vec_id long, dist double, rank long")
    return top_k(parts, k, ["qid"], ["dist", "vec_id"])


def exact_knn_join(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """`exact_knn` as a join, with nothing on the driver: both sides are dealt into parts by hash of their ids, and each pair of parts
    meets in one group, which gives k rows a query."""
    base, queries, spark = base.filter("embedding is not null"), queries.filter("q is not null"), base.sparkSession
    n, m = base.count(), queries.count()
    across, down = max(1, -(-n // PART_ROWS), min(2 * spark.sparkContext.defaultParallelism, n // 4096)), max(1, -(-m // PART_ROWS))
    part = lambda name, parts: F.pmod(F.xxhash64(name), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            vectors, asked = (t.combine_chunks() for t in (left, right))
            ids, lists, qid, q = (c.chunk(0) for c in (vectors["vec_id"], vectors["embedding"], asked["qid"], asked["q"]))
            for width in np.unique(np.diff(q.offsets.to_numpy())).tolist():
                mine, wide = _rows(qid, q, width)
                theirs, x = _rows(ids, lists, width)
                best = Nearest(len(mine), k)
                best.compare(x, theirs, np.zeros(len(theirs), np.int64), wide.astype(np.float64), np.arange(len(mine)))
                out.append(best.rows(mine).select(["qid", "vec_id", "dist"]))
        return pa.Table.from_batches(out, pa.schema([("qid", pa.int64()), ("vec_id", pa.int64()), ("dist", pa.float64())]))

    left = base.select("vec_id", "embedding", part("vec_id", across).alias("i"), every(down).alias("j")).groupBy("i", "j")
    right = queries.select("qid", "q", every(across).alias("i"), part("qid", down).alias("j")).groupBy("i", "j")
    return top_k(left.cogroup(right).applyInArrow(run, "qid long, vec_id long, dist double"), k, ["qid"], ["dist", "vec_id"])


def _rows(ids: pa.Array, lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of the vectors that have `width` dimensions."""
    at, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy(zero_copy_only=False)
    keep = np.flatnonzero(np.diff(at) == width)
    return ids.to_numpy()[keep], flat[at[keep][:, None] + np.arange(width)]


def query_batches(queries: DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(qids, matrix) in batches of at most MOST_QUERY_BYTES, streamed to the driver partition by partition."""
    qid, q, size = [], [], 0
    for row in queries.select("qid", "q").toLocalIterator():
        v = np.asarray(row["q"], np.float32)
        if q and (size + v.nbytes > MOST_QUERY_BYTES or len(v) != len(q[0])):
            yield np.array(qid), np.stack(q)
            qid, q, size = [], [], 0
        qid.append(row["qid"])
        q.append(v)
        size += v.nbytes
    if q:
        yield np.array(qid), np.stack(q)


def recall(found: DataFrame, truth: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, recall, n_found) for every query of `queries` (qid), of found (qid, rank, vec_id) against truth (qid, gt): the
    share of the first least(k, found, gt) entries of each that agree; 0 if that is none, as for a query that finds
    nothing; -1 for queries without a truth row."""
    got = found.filter(F.col("rank") <= k).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("p")).select("qid", F.col("p.vec_id").alias("pred"))
    both = queries.select("qid").join(got, "qid", "left").join(truth.select("qid", F.col("gt").cast("array<long>").alias("gt")), "qid", "left").withColumn("pred", F.coalesce("pred", F.expr("cast(array() as array<long>)")))
    n = F.least(F.lit(k), F.size("pred"), F.size("gt"))
    share = F.size(F.array_intersect(F.slice("pred", F.lit(1), n), F.slice("gt", F.lit(1), n))) / n
    value = F.when(F.col("gt").isNull(), F.lit(-1.0)).when(n == 0, F.lit(0.0)).otherwise(share)
    return both.select("qid", value.cast(T.DoubleType()).alias("recall"), F.size("pred").cast("long").alias("n_found"))
