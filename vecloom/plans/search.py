"""The three searches over one index, and what they report.

An index is lists (cluster_id, local_idx, vec_id, embedding) and centroids (`vecloom.sources.catalog`), saved or not.
Queries are rows (qid, q). Lists are scanned where they lie, only in buckets that are probed; every search ends in one
shuffle of k rows per query and task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.distance import l2
from vecloom.operators import coarse, ivf, pq, thresholds
from vecloom.operators.topk import exact_knn, top_k
from vecloom.plans import scanning as S
from vecloom.plans.params import PqParams, SearchParams, StagedParams
from vecloom.sources.catalog import Index
from vecloom.sources.shared import Scratch, discard


def limited(queries: DataFrame, params: SearchParams) -> DataFrame:
    """The first max_queries queries in the order of qid, whatever their ids; all if it is 0."""
    return queries.orderBy("qid").limit(params.max_queries) if params.max_queries else queries


def coarse_probes(index: Index, queries: DataFrame, params: SearchParams) -> DataFrame:
    """(qid, probe_rank, cluster_id, dist): the clusters that each query probes, by the backend that the parameters name."""
    if params.coarse_backend == "brute":
        return ivf.probes(queries, index.centroids, params.nprobe)
    if index.graph is None:
        raise ValueError("the index has no graph")
    return coarse.probes(queries, coarse.graph(index.centroids, index.graph, params.coarse_width), params.nprobe)


def candidate_counts(index: Index, probes: DataFrame) -> DataFrame:
    """(qid, n): entries of each query's probed clusters, from the clusters' sizes."""
    return probes.join(index.clusters.select("cluster_id", "num_vectors"), "cluster_id").groupBy("qid").agg(F.sum("num_vectors").alias("n"))


def _together(index: Index, parts: Iterator[DataFrame], schema: str) -> DataFrame:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return index.lists.sparkSession.createDataFrame([], schema) if out is None else out


def ivf_flat(index: Index, queries: DataFrame, params: SearchParams) -> DataFrame:
    """(qid, rank, vec_id, dist): the nearest vectors in the probed clusters. A vector in several lists may be found twice."""
    queries = limited(queries, params)
    batches = S.query_batches(queries, coarse_probes(index, queries, params))
    rows = _together(index, (S.nearest_entries(index, b, params.k) for b in batches), S.FOUND)
    return top_k(rows.drop("slot"), params.k, ["qid"], ["dist", "vec_id"])


@dataclass
class StagedRun:
    """A staged search: what it finds, and its figures. Each is one scan of the probed lists, in which a task prunes stage by stage
    and gives sums or k rows a query, never the survivors; `batches` gives those of the queries. With `stages` (asked for by
    `keep_stages`) the survivors (qid, slot, vec_id, dist so far) of each stage are written tables, and all comes from them.
    `candidates` (qid, n) are those it began with."""

    stages: list[DataFrame]
    candidates: DataFrame
    probes: DataFrame
    params: StagedParams
    scratch: Scratch
    index: Index
    batches: Callable[[], Iterator[S.QueryBatch]]

    def _scan(self, one: Callable[..., DataFrame], schema: str, *more) -> DataFrame:
        factors = [float(p) for p in self.params.proportions]
        return _together(self.index, (one(self.index, b, self.params.ends, factors, *more) for b in self.batches()), schema)

    def top(self) -> DataFrame:
        """(qid, rank, vec_id, dist) of the last stage's survivors."""
        rows = self.stages[-1] if self.stages else self._scan(S.staged_entries, S.FOUND, self.params.k)
        return top_k(rows.drop("slot"), self.params.k, ["qid"], ["dist", "vec_id"])

    def counters(self) -> DataFrame:
        """(qid, stage, n_in, n_out, n_pruned, bytes); a query has a row for each stage that anything reaches. Survivors are
        counted where they lie, by query."""
        if not self.stages:
            counts = self.scratch.table(self._scan(S.staged_counts, S.COUNTED).groupBy("qid", "stage").agg(F.sum("n").alias("n")), "counts")
        before, out = self.candidates, None
        for s in range(len(self.params.ends)):
            after = self.stages[s].groupBy("qid").agg(F.count("*").alias("n")) if self.stages else counts.filter(F.col("stage") == s).select("qid", "n")
            row = before.withColumnRenamed("n", "n_in").filter("n_in > 0").join(after.withColumnRenamed("n", "n_out"), "qid", "left").withColumn("n_out", F.coalesce("n_out", F.lit(0)))
            row = row.select("qid", F.lit(s).cast("long").alias("stage"), "n_in", "n_out", (F.col("n_in") - F.col("n_out")).alias("n_pruned"), (F.col("n_in") * self.params.shard_dims[s] * 4).cast("long").alias("bytes"))
            out, before = row if out is None else out.unionByName(row), after
        return out

    def reads(self, index: Index) -> DataFrame:
        """(stage, entries, bytes, full_bytes): distinct entries whose segment a stage needs, their bytes, and the bytes of that
        segment over all entries of probed clusters, which a search without stages would read."""
        if not self.stages:
            stages = len(self.params.ends)
            reach = self._scan(S.staged_reach, S.REACHED).groupBy("slot").agg(F.max("stages").alias("stages")).groupBy("stages").agg(F.count("*").alias("n"))
            reach = self.scratch.table(reach, "reach")  # a row for each stage
        probed = self.probes.select("cluster_id").distinct().join(index.clusters.select("cluster_id", "num_vectors"), "cluster_id").agg(F.coalesce(F.sum("num_vectors"), F.lit(0)).alias("all"))
        out = None
        for s, dim in enumerate(self.params.shard_dims):
            if s == 0:
                wanted = probed.withColumnRenamed("all", "n")
            elif self.stages:
                wanted = self.stages[s - 1].agg(F.count_distinct("slot").alias("n"))
            else:
                wanted = reach.filter(F.col("stages").between(s, stages)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
            row = wanted.select(F.lit(s).cast("long").alias("stage"), F.col("n").cast("long").alias("entries"), (F.col("n") * dim * 4).cast("long").alias("bytes"), F.lit(dim * 4).alias("width"))
            out = row if out is None else out.unionByName(row)
        return out.crossJoin(F.broadcast(probed)).select("stage", "entries", "bytes", (F.col("all") * F.col("width")).cast("long").alias("full_bytes"))  # one row

    def first_reads(self, per: int) -> DataFrame:
        """(qid, reads, sectors): runs of neighbouring bundles of `per` entries that the first stage's survivors lie in, and those
        bundles. A read ends where a batch of S.READ places does."""
        first, factor = self.params.ends[0], float(self.params.proportions[0])
        rows = _together(self.index, (S.first_bundles(self.index, b, first, factor, per) for b in self.batches()), S.BUNDLES)
        cut = rows.groupBy("qid", "cluster_id", "batch").agg(F.bit_or("bundles").alias("bits"), F.sum("reads").alias("reads"), F.sum("sectors").alias("sectors"))
        starts = F.col("bits").bitwiseAND(F.bitwise_not(F.shiftleft("bits", 1)))
        return cut.groupBy("qid").agg(F.sum(F.col("reads") + F.bit_count(starts)).alias("reads"), F.sum(F.col("sectors") + F.bit_count("bits")).alias("sectors"))


def staged(index: Index, queries: DataFrame, params: StagedParams, keep_stages: bool = False) -> StagedRun:
    """A search stage by stage: a stage drops a candidate whose distance so far is over threshold * proportion, and the next
    compares its dimensions of the others only. All stages of a block of entries follow one another in the task that holds
    it, as survivors can be nearly all pairs of queries and entries, which no table should hold.

    With `keep_stages` they are written nevertheless: the first stage scans the first segment of the probed lists; each later
    one fetches its segment for the survivors of the one before, by their slots, and no other.
    """
    queries, spark = limited(queries, params), index.lists.sparkSession
    probes = coarse_probes(index, queries, params)
    if params.prune_threshold_mode == "sampled":
        entries = index.entries("cluster_id", "local_idx", "vec_id", "embedding")
        limits = thresholds.sampled(thresholds.prune_sample(entries, index.clusters), queries)
    else:
        limits = thresholds.centroid(probes, params.nprobe)
    scratch, batches = Scratch(), lambda: S.query_batches(queries, probes, limits)
    stages: list[DataFrame] = []
    if keep_stages:
        parts: list[list[DataFrame]] = [[] for _ in params.ends]
        for batch in batches():
            rows = scratch.table(S.entries_under(index, batch, params.ends[0], float(params.proportions[0])), "stage")
            parts[0].append(rows)
            for s in range(1, len(params.ends)):
                first, last = params.ends[s - 1], params.ends[s]
                with S.runtime_filters(spark):
                    rows = scratch.table(S.extended(S.fetch(index, rows, f"seg:{first}:{last}"), batch, first, last, float(params.proportions[s])), "stage")
                parts[s].append(rows)
        stages = [_together(index, iter(p), S.FOUND) for p in parts]
    return StagedRun(stages, candidate_counts(index, probes), probes, params, scratch, index, batches)


def adc_scan(index: Index, queries: DataFrame, params: PqParams) -> DataFrame:
    """(qid, adc_rank, slot, vec_id, adc): the rerank_k candidates that are nearest by code. Only ids and codes are read."""
    queries = limited(queries, params)
    book = pq.codebook_array(index.codebooks)
    if len(book) != params.m:
        raise ValueError(f"the codebooks have {len(book)} parts, not {params.m}")
    batches = S.query_batches(queries, coarse_probes(index, queries, params), bytes_a_query=8 * book.shape[0] * book.shape[1])
    rows = _together(index, (S.nearest_codes(index, b, book, params.rerank_k) for b in batches), S.FOUND)
    return top_k(rows.withColumnRenamed("dist", "adc"), params.rerank_k, ["qid"], ["adc", "vec_id"], "adc_rank")


def rerank(index: Index, scan: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, vec_id, dist): the k nearest of the scanned candidates by exact distance. `scan` is written first; vectors
    are fetched by its slots."""
    scratch = Scratch()
    wanted = scratch.table(scan.select("qid", "slot", "vec_id"), "rerank")
    with S.runtime_filters(index.lists.sparkSession):
        rows = S.fetch(index, wanted, "embedding").join(queries.select("qid", "q"), "qid")
        found = scratch.table(top_k(rows.select("qid", "vec_id", l2(F.col("embedding"), F.col("q")).alias("dist")), k, ["qid"], ["dist", "vec_id"]), "reranked")
    discard(wanted)
    return found


def ground_truth(base: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(qid, gt): ids of the k nearest vectors, in order."""
    rows = exact_knn(base, queries, k)
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("g")).select("qid", F.col("g.vec_id").alias("gt"))


