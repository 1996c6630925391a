"""Scans of probed lists where they lie.

Queries go to the tasks in batches of bounded bytes, each with the clusters it probes; the lists are neither shuffled nor
copied for each query. A task works through runs of one cluster, with all queries of the batch that probe it, and keeps
what its kernel needs: the k nearest, or the candidates under a threshold. All distances are left folds over the
dimensions in double precision, as everywhere else.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.functions.distance import fold_l2, pair_l2, prefixes_l2, product_l2, where
from vecloom.operators.topk import BLOCK_CELLS, MOST_QUERY_BYTES, Nearest, tiles
from vecloom.sources.catalog import SLOT_BITS, Index, cluster_of

READ = 256  # places of a list that are read together
FEW = 8  # a tile with fewer than one pair in so many left is summed pair by pair
MOST_CUT = 256  # groups of READ places that a task waits to see whole
# Runtime filters are worth their while up to so many bytes of wanted rows; a larger set would fill the filter.
FILTER_CONFS = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "256MB",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
}


@contextlib.contextmanager
def runtime_filters(spark: SparkSession) -> Iterator[None]:
    """While a plan runs in here, Spark puts a Bloom filter of the smaller side of a shuffled join on the larger side's scan."""
    before = {k: spark.conf.get(k, None) for k in FILTER_CONFS}
    for k, v in FILTER_CONFS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass(frozen=True)
class QueryBatch:
    """Queries in ascending order of qid; `clusters`, sorted, with the row in q of each query that probes it in `asks`."""

    qid: np.ndarray
    q: np.ndarray
    clusters: np.ndarray
    asks: np.ndarray
    limit: np.ndarray

    def asking(self, cluster: int) -> np.ndarray:
        lo, hi = np.searchsorted(self.clusters, [cluster, cluster + 1])
        return self.asks[lo:hi]

    def buckets(self, index: Index) -> set[int] | None:
        return set((np.unique(self.clusters) % index.buckets).tolist()) if index.buckets else None


def query_batches(queries: DataFrame, probes: DataFrame, limits: DataFrame | None = None, bytes_a_query: int = 0, most: int = MOST_QUERY_BYTES) -> Iterator[QueryBatch]:
    """The queries (qid, q) with their probes (qid, cluster_id) and limits (qid, threshold), in batches of at most `most` bytes,
    streamed to the driver partition by partition."""
    rows = queries.select("qid", "q").join(probes.groupBy("qid").agg(F.collect_list("cluster_id").alias("clusters")), "qid")
    rows = rows.join(limits.select("qid", "threshold"), "qid") if limits is not None else rows.withColumn("threshold", F.lit(0.0))
    held, size = [], 0

    def batch() -> QueryBatch:
        held.sort(key=lambda r: r["qid"])
        n = [len(r["clusters"]) for r in held]
        clusters, asks = np.concatenate([np.array(r["clusters"], np.int64) for r in held]), np.repeat(np.arange(len(held)), n)
        order = np.lexsort((asks, clusters))
        return QueryBatch(np.array([r["qid"] for r in held], np.int64), np.array([r["q"] for r in held], np.float32), clusters[order], asks[order], np.array([r["threshold"] for r in held], float))

    for row in rows.toLocalIterator():
        own = bytes_a_query + 4 * len(row["q"]) + 16 * len(row["clusters"])
        if held and size + own > most:
            yield batch()
            held, size = [], 0
        held.append(row)
        size += own
    if held:
        yield batch()


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """The rows of a list column as a matrix without a copy; an error where a row has another length."""
    if lists.null_count or (np.diff(lists.offsets.to_numpy()) != width).any():
        raise ValueError(f"entries of a list should have {width} values")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), width)


def _lists(cluster: np.ndarray, batch: QueryBatch) -> Iterator[tuple[slice, np.ndarray]]:
    """(rows of one cluster, the batch's queries that probe it)."""
    edges = [0, *(np.flatnonzero(cluster[1:] != cluster[:-1]) + 1).tolist(), len(cluster)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        if lo < hi and len(asks := batch.asking(int(cluster[lo]))):
            yield slice(lo, hi), asks


def _runs(cluster: np.ndarray, batch: QueryBatch) -> Iterator[tuple[slice, np.ndarray]]:
    """`_lists` in blocks of bounded cells."""
    for rows, asks in _lists(cluster, batch):
        step = max(1, BLOCK_CELLS // len(asks))
        for s in range(rows.start, rows.stop, step):
            yield slice(s, min(s + step, rows.stop)), asks


FOUND = "qid long, slot long, vec_id long, dist double"


def nearest_entries(index: Index, batch: QueryBatch, k: int) -> DataFrame:
    """(qid, slot, vec_id, dist): for each task that reads lists the k nearest entries of each query's probed clusters."""
    shared = index.lists.sparkSession.sparkContext.broadcast(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = shared.value
        best, q = Nearest(len(batch.qid), k), batch.q.astype(np.float64)
        for b in batches:
            cluster, slots, ids = (b.column(i).to_numpy() for i in range(3))
            x = _matrix(b.column(3), q.shape[1])
            for rows, asks in _lists(cluster, batch):
                best.compare(x[rows], ids[rows], slots[rows], q, asks)
        yield best.rows(batch.qid)

    return index.entries("cluster_id", "slot", "vec_id", "embedding", buckets=batch.buckets(index)).mapInArrow(run, FOUND)


def nearest_codes(index: Index, batch: QueryBatch, book: np.ndarray, k: int) -> DataFrame:
    """`nearest_entries` by the distance tables of the codebooks (m, ksub, subdim). Only ids and codes are read."""
    spark = index.lists.sparkSession.sparkContext
    shared, books = spark.broadcast(batch), spark.broadcast(book)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch, book = shared.value, books.value
        m, _, n = book.shape
        tables = [fold_l2(book[p], batch.q[:, p * n : (p + 1) * n]) for p in range(m)]  # of each part: code, query
        best = Nearest(len(batch.qid), k)
        for b in batches:
            cluster, slots, ids = (b.column(i).to_numpy() for i in range(3))
            codes = _matrix(b.column(3), m)
            for rows, asks in _lists(cluster, batch):
                for r, s in tiles(rows.stop - rows.start, len(asks)):
                    r, mine = slice(rows.start + r.start, rows.start + r.stop), asks[s]
                    d = np.zeros((r.stop - r.start, len(mine)))
                    for p in range(m):
                        d += np.take(tables[p], mine, axis=1)[codes[r, p]]
                    row, at = where(best.likely(d, mine))
                    best.add(mine[at], d[row, at], ids[r][row], slots[r][row])
        yield best.rows(batch.qid)

    return index.entries("cluster_id", "slot", "vec_id", "codes", buckets=batch.buckets(index)).mapInArrow(run, FOUND)


def entries_under(index: Index, batch: QueryBatch, last: int, factor: float) -> DataFrame:
    """(qid, slot, vec_id, dist): entries of the probed clusters whose distance over the first `last` dimensions is not over the
    query's limit times `factor`. An equal one stays, and so does NaN."""
    shared = index.lists.sparkSession.sparkContext.broadcast(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = shared.value
        for b in batches:
            cluster, slots, ids = (b.column(i).to_numpy() for i in range(3))
            x = _matrix(b.column(3), last)
            for rows, asks in _runs(cluster, batch):
                d = fold_l2(x[rows], batch.q[asks, :last])
                row, ask = np.nonzero(~(d > (batch.limit[asks] * factor)[None]))
                yield pa.RecordBatch.from_arrays([pa.array(batch.qid[asks[ask]]), pa.array(slots[rows][row]), pa.array(ids[rows][row]), pa.array(d[row, ask])], names=["qid", "slot", "vec_id", "dist"])

    return index.entries("cluster_id", "slot", "vec_id", f"seg:0:{last}", buckets=batch.buckets(index)).mapInArrow(run, FOUND)


def _pruned(x: np.ndarray, q: np.ndarray, limits: np.ndarray, asks: np.ndarray, ends: Sequence[int]) -> Iterator[tuple[slice, slice, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows x against q[asks], by tiles and stages, while any pair is left: (rows, asks, stage, alive, d, slack). `alive` tells which
    pairs have passed the stage, by `limits` (query, stage); d is their distance so far, up to `slack`. A pair whose distance
    is that near its limit is summed exactly. An equal one stays, and so does NaN."""
    for r, s in tiles(len(x), len(asks)):
        here, theirs, limit = x[r].astype(np.float64), q[asks[s]], limits[asks[s]]
        alive, first, d, slack = None, 0, None, 0.0
        for stage, last in enumerate(ends):
            more, err = product_l2(here[:, first:last], theirs[:, first:last])
            d, slack, first = more if d is None else np.add(d, more, out=more), slack + err, last
            out = d > limit[:, stage] + slack
            near = ~(out | (d < limit[:, stage] - slack))
            if alive is None:
                alive = ~out
            else:
                near &= alive
                alive = alive & ~out
            row, at = where(near)
            alive[row, at] = ~(pair_l2(here[:, :last], theirs[:, :last], row, at) > limit[at, stage])
            left = np.count_nonzero(alive)
            if not left:
                break
            yield r, s, stage, alive, d, slack
            if left * FEW < alive.size and last < ends[-1]:
                yield from ((r, s, *found) for found in _few_left(here, theirs, limit, alive, stage, ends))
                break


def _few_left(x: np.ndarray, q: np.ndarray, limit: np.ndarray, alive: np.ndarray, stage: int, ends: Sequence[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """What `_pruned` gives of the stages after `stage`, by exact sums of the pairs that are left."""
    row, at = where(alive)
    sums = prefixes_l2(x, q, row, at, ends[stage + 1 :])
    for later in range(stage + 1, len(ends)):
        own = sums[:, later - stage - 1]
        keep = ~(own > limit[at, later])
        row, at, sums, own = row[keep], at[keep], sums[keep], own[keep]
        if not len(row):
            break
        alive, d = np.zeros(alive.shape, bool), np.full(alive.shape, np.inf)
        alive[row, at], d[row, at] = True, own
        yield later, alive, d, np.zeros(len(q))


def _each_list(index: Index, batch: QueryBatch, make: Callable[[QueryBatch], tuple[Callable, Callable]], schema: str) -> DataFrame:
    """Rows of the batch's probed lists by `make`: it gives what takes (x, slots, ids, queries) of one list and what is called in the
    end; both give record batches."""
    shared = index.lists.sparkSession.sparkContext.broadcast(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = shared.value
        take, end = make(batch)
        for b in batches:
            cluster, slots, ids = (b.column(i).to_numpy() for i in range(3))
            x = _matrix(b.column(3), batch.q.shape[1])
            for rows, asks in _lists(cluster, batch):
                yield from take(x[rows], slots[rows], ids[rows], asks)
        yield from end()

    return index.entries("cluster_id", "slot", "vec_id", "embedding", buckets=batch.buckets(index)).mapInArrow(run, schema)


def _limits(batch: QueryBatch, factors: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    return batch.q.astype(np.float64), batch.limit[:, None] * np.array(factors, float)


def staged_entries(index: Index, batch: QueryBatch, ends: Sequence[int], factors: Sequence[float], k: int) -> DataFrame:
    """`nearest_entries` of those that pass all stages. A stage compares only what the stage before has left, where it lies."""

    def make(batch: QueryBatch):
        best, (q, limits) = Nearest(len(batch.qid), k), _limits(batch, factors)

        def take(x, slots, ids, asks):
            for r, s, stage, alive, d, slack in _pruned(x, q, limits, asks, ends):
                if stage == len(ends) - 1:
                    mine = asks[s]
                    d[~alive] = np.inf
                    row, at = where(alive & best.likely(d, mine, slack))
                    best.add(mine[at], pair_l2(x[r], q, row, mine[at]), ids[r][row], slots[r][row])
            return ()

        return take, lambda: [best.rows(batch.qid)]

    return _each_list(index, batch, make, FOUND)


COUNTED = "qid long, stage long, n long"


def staged_counts(index: Index, batch: QueryBatch, ends: Sequence[int], factors: Sequence[float]) -> DataFrame:
    """(qid, stage, n): how many candidates pass each stage, a row for each task in which any do."""

    def make(batch: QueryBatch):
        counts, (q, limits) = np.zeros((len(batch.qid), len(ends)), np.int64), _limits(batch, factors)

        def take(x, slots, ids, asks):
            for _, s, stage, alive, _, _ in _pruned(x, q, limits, asks, ends):
                counts[asks[s], stage] += alive.sum(axis=0)
            return ()

        def end():
            at, stage = np.nonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(batch.qid[at]), pa.array(stage), pa.array(counts[at, stage])], names=["qid", "stage", "n"])

        return take, end

    return _each_list(index, batch, make, COUNTED)


REACHED = "slot long, stages long"


def staged_reach(index: Index, batch: QueryBatch, ends: Sequence[int], factors: Sequence[float]) -> DataFrame:
    """(slot, stages): how many stages an entry passes for any query of the batch, where it passes one."""

    def make(batch: QueryBatch):
        q, limits = _limits(batch, factors)

        def take(x, slots, ids, asks):
            stages = np.zeros(len(x), np.int64)
            for r, _, stage, alive, _, _ in _pruned(x, q, limits, asks, ends):
                stages[r] = np.maximum(stages[r], (stage + 1) * alive.any(axis=1))
            some = stages > 0
            yield pa.RecordBatch.from_arrays([pa.array(slots[some]), pa.array(stages[some])], names=["slot", "stages"])

        return take, lambda: ()

    return _each_list(index, batch, make, REACHED)


BUNDLES = "qid long, cluster_id long, batch long, bundles long, reads long, sectors long"


def first_bundles(index: Index, batch: QueryBatch, last: int, factor: float, per: int) -> DataFrame:
    """(qid, cluster_id, batch, bundles, reads, sectors): what the first stage's survivors want read, with `per` entries to a bundle.

    A group of READ places whose entries all came to one task is counted there: its runs of bundles are reads, its bundles
    sectors (cluster_id and batch are -1). Of one that is cut the bundles are given as bits, for the groups to be put together.
    """
    if READ // per + 2 > 62:
        raise ValueError(f"bundles of {per} entries are too many for the bits of a number")
    size = {r["cluster_id"]: r["num_vectors"] for r in index.clusters.select("cluster_id", "num_vectors").collect()}  # a row for each cluster

    def make(batch: QueryBatch):
        q, limits = _limits(batch, [factor])
        reads, sectors, cut = np.zeros(len(batch.qid), np.int64), np.zeros(len(batch.qid), np.int64), {}

        def rows(qid, cluster, group, bundles, reads, sectors):
            full = lambda v: pa.array(np.broadcast_to(np.asarray(v, np.int64), len(qid)))
            return pa.RecordBatch.from_arrays([pa.array(qid), full(cluster), full(group), full(bundles), full(reads), full(sectors)], names=[c.split()[0] for c in BUNDLES.split(", ")])

        def take(x, slots, ids, asks):
            order = np.argsort(slots)
            x, cluster, place = x[order], int(slots[0] >> SLOT_BITS), slots[order] & ((1 << SLOT_BITS) - 1)
            group = place // READ
            bundle = place // per - group * READ // per
            for g, n in zip(*np.unique(group, return_counts=True), strict=True):
                cut.setdefault((cluster, int(g)), [0, np.zeros(len(asks), np.int64)])[0] += n
            for r, s, _, alive, _, _ in _pruned(x, q, limits, asks, [last]):
                g, b = group[r], bundle[r]
                starts = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (b[1:] != b[:-1])])
                for i, wanted in zip(starts, np.logical_or.reduceat(alive, starts, axis=0), strict=True):
                    cut[cluster, int(g[i])][1][s] |= wanted.astype(np.int64) << b[i]
            for g in np.unique(group).tolist():
                seen, bits = cut[cluster, g]
                if seen == min(READ, size[cluster] - g * READ):
                    del cut[cluster, g]
                    reads[asks] += np.bitwise_count(bits & ~(bits << 1))
                    sectors[asks] += np.bitwise_count(bits)
            if len(cut) > MOST_CUT:
                yield from parts()

        def parts():
            for (cluster, g), (_, bits) in cut.items():
                some = np.flatnonzero(bits)
                yield rows(batch.qid[batch.asking(cluster)[some]], cluster, g, bits[some], 0, 0)
            cut.clear()

        def end():
            yield from parts()
            some = np.flatnonzero(reads)
            yield rows(batch.qid[some], -1, -1, 0, reads[some], sectors[some])

        return take, end

    return _each_list(index, batch, make, BUNDLES)


def fetch(index: Index, wanted: DataFrame, *columns: str) -> DataFrame:
    """The rows of `wanted` (slot, ...), a table that has been written, with columns of their entries.

    Only buckets that hold a wanted slot are read (their numbers go through the driver, as many as the index has buckets at
    most), and of these only the named columns. Run within `runtime_filters`, entries nobody wants go before the shuffle.
    """
    buckets = None
    if index.buckets:
        buckets = [r[0] for r in wanted.select(index.bucket_of(cluster_of(F.col("slot"))).alias("b")).distinct().collect()]
    some = wanted.filter("slot >= 0")  # always so; Spark makes runtime filters of filtered scans only
    return some.join(index.entries("slot", *columns, buckets=buckets), "slot")


def extended(rows: DataFrame, batch: QueryBatch, first: int, last: int, factor: float) -> DataFrame:
    """`rows` (qid, slot, vec_id, dist, seg) with dimensions first .. last - 1 added to their distances, less those then over
    the limit times `factor`."""
    shared = rows.sparkSession.sparkContext.broadcast(batch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = shared.value
        for b in batches:
            at = np.searchsorted(batch.qid, b.column(0).to_numpy())
            d, x = b.column(3).to_numpy().copy(), _matrix(b.column(4), last - first)
            for j in range(last - first):
                diff = x[:, j].astype(float) - batch.q[at, first + j].astype(float)
                d += diff * diff
            keep = pa.array(~(d > batch.limit[at] * factor))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(d)], names=["qid", "slot", "vec_id", "dist"]).filter(keep)

    return rows.select("qid", "slot", "vec_id", "dist", "seg").mapInArrow(run, FOUND)
