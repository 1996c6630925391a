"""Stable matching of vectors to clusters of bounded sizes, by cutoffs.

Vectors have a common order, their turn; each wants the first of its candidates that has room for it, and clusters prefer
earlier turns. A matching is then told by one number for each cluster, the last turn that it takes. Cutoffs fall round by
round: with those of the round before, each vector has a choice; where a cluster is chosen by more than fit, its new
cutoff is the turn of the last that fits. No vector is rewritten or sent anywhere: a round counts choices by cluster and
range of turns, and then looks into the one range of each full cluster in which its cutoff falls.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RANGES = 1024  # of turns; a window holds a cluster's choices of one range
LAST = np.iinfo(np.int64).max


@dataclass
class Cutoffs:
    """Per cluster the last (turn, vec_id) that it takes."""

    turn: np.ndarray
    vec_id: np.ndarray

    def choices(self, lists: pa.Array, turn: np.ndarray, vec_id: np.ndarray) -> np.ndarray:
        """The first candidate of each vector that takes it, or -1."""
        n = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(n)), n)
        takes = (turn[owner] < self.turn[flat]) | ((turn[owner] == self.turn[flat]) & (vec_id[owner] <= self.vec_id[flat]))
        at = np.flatnonzero(takes)[::-1]
        out = np.full(len(n), -1)
        out[owner[at]] = flat[at]  # the earliest is written last
        return out


def _mapped(wishes: DataFrame, cutoffs: Cutoffs, edges: np.ndarray, inside: np.ndarray | None) -> DataFrame:
    """Numbers of choices by (cluster_id, range); or, for the one range of each cluster that `inside` names, (cluster_id, turn,
    vec_id) of those who choose it."""
    shared = wishes.sparkSession.sparkContext.broadcast((cutoffs, edges, inside))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutoffs, edges, inside = shared.value
        keys, counts = [], []
        for b in batches:
            turn, vec_id = b.column(1).to_numpy(), b.column(2).to_numpy()
            choice = cutoffs.choices(b.column(0), turn, vec_id)
            place = np.searchsorted(edges, turn, "right")
            some = np.flatnonzero(choice >= 0)
            if inside is not None:
                some = some[inside[choice[some]] == place[some]]
                yield pa.RecordBatch.from_arrays([pa.array(choice[some]), pa.array(turn[some]), pa.array(vec_id[some])], names=["cluster_id", "turn", "vec_id"])
                continue
            key, n = np.unique(choice[some] * (len(edges) + 1) + place[some], return_counts=True)
            keys.append(key)
            counts.append(n)
        if keys:
            key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(inverse, np.concatenate(counts), len(key)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(key // (len(edges) + 1)), pa.array(key % (len(edges) + 1)), pa.array(total)], names=["cluster_id", "range", "n"])

    kind = "cluster_id long, range long, n long" if inside is None else "cluster_id long, turn long, vec_id long"
    return wishes.select("c", "turn", "vec_id").mapInArrow(run, kind)


def match(wishes: DataFrame, capacity: np.ndarray, ranges: int = RANGES) -> Cutoffs:
    """Cutoffs for `wishes` (vec_id, turn, c), a written table with candidates c in order of preference, whole numbers below
    len(capacity). What reaches the driver in a round is a row for each cluster that is over its capacity."""
    cutoffs = Cutoffs(np.where(capacity > 0, LAST, -LAST - 1), np.where(capacity > 0, LAST, -LAST - 1))
    cuts = wishes.approxQuantile("turn", [i / ranges for i in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    edges = np.unique(np.clip(np.array(cuts or [0.0]), -9e18, 9e18).astype(np.int64))
    room = wishes.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(capacity)], "cluster_id long, room long")  # a row for each cluster
    while True:
        counts = _mapped(wishes, cutoffs, edges, None).groupBy("cluster_id", "range").agg(F.sum("n").alias("n"))
        ends = counts.withColumn("end", F.sum("n").over(W.partitionBy("cluster_id").orderBy("range"))).join(room, "cluster_id")
        full = ends.filter("end > room").groupBy("cluster_id").agg(F.min(F.struct("range", (F.col("room") - F.col("end") + F.col("n")).alias("fit"))).alias("r")).collect()
        if not full:
            return cutoffs
        inside, fit = np.full(len(capacity), -1), {}
        for r in full:
            inside[r["cluster_id"]], fit[r["cluster_id"]] = r["r"]["range"], r["r"]["fit"]
        fits = wishes.sparkSession.createDataFrame(list(fit.items()), "cluster_id long, fit long")
        place = F.row_number().over(W.partitionBy("cluster_id").orderBy("turn", "vec_id"))
        within = _mapped(wishes, cutoffs, edges, inside).withColumn("place", place).join(fits, "cluster_id")
        # The last that fits; if none of the range does, the first of it is the first to be left out.
        last = within.filter("place = greatest(fit, 1)").select("cluster_id", "turn", "vec_id", "fit").collect()
        for r in last:
            cutoffs.turn[r["cluster_id"]], cutoffs.vec_id[r["cluster_id"]] = r["turn"], r["vec_id"] - (r["fit"] < 1)


def chosen(wishes: DataFrame, cutoffs: Cutoffs) -> DataFrame:
    """`wishes` with the cluster_id of each vector; null where no candidate takes it. No shuffle."""
    shared = wishes.sparkSession.sparkContext.broadcast(cutoffs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            choice = shared.value.choices(b.column(0), b.column(1).to_numpy(), b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(choice, mask=choice < 0)], names=["c", "turn", "vec_id", "cluster_id"])

    return wishes.select("c", "turn", "vec_id").mapInArrow(run, "c array<long>, turn long, vec_id long, cluster_id long")
