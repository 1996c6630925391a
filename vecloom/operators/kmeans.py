"""k-means training: parallel seeding, Lloyd iterations, mini-batches, restarts, and no empty clusters.

Every pass over the vectors is a map that keeps, for each cluster and task, a sum, a count, a cost and the farthest vector;
those are added up by cluster, and a row for each cluster reaches the driver, which holds the centroids only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.topk import BLOCK_CELLS
from vecloom.sources.shared import Scratch

PARTS = "c long, s array<double>, n long, cost double, far double, x array<float>"


def matrix_of(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def blocks(x: np.ndarray, c: np.ndarray, cells: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows in double precision, nearest of c, squared distance to it) in blocks of bounded cells."""
    half = (c * c).sum(axis=1) / 2
    step = max(1, cells // len(c))
    for s in range(0, len(x), step):
        rows = x[s : s + step].astype(np.float64)
        score = half[None] - rows @ c.T
        label = np.argmin(score, axis=1)
        yield rows, label, np.maximum(2 * score[np.arange(len(rows)), label] + (rows * rows).sum(axis=1), 0)


@dataclass
class Pass:
    """Per cluster: sums, counts, the farthest vector and its squared distance; and the cost of all vectors."""

    sums: np.ndarray
    counts: np.ndarray
    far: np.ndarray
    x: np.ndarray
    cost: float

    def means(self, old: np.ndarray) -> np.ndarray:
        """New centroids; an empty cluster keeps its old one."""
        some = self.counts > 0
        new = old.copy()
        new[some] = (self.sums[some] / self.counts[some, None]).astype(np.float32)
        return new

    def refilled(self, least: int) -> int:
        """Splits clusters until none has fewer than `least` members that can be helped: each such cluster takes over the farthest
        vector of one of the largest, whose sum and count give it up. Returns how many were refilled."""
        poor = np.flatnonzero(self.counts < least)
        donors = [d for d in np.lexsort((np.arange(len(self.counts)), -self.counts)) if self.counts[d] > least and self.far[d] > 0]
        for p, d in zip(poor, donors, strict=False):
            x = self.x[d].astype(np.float64)
            self.sums[d] -= x
            self.counts[d] -= 1
            self.sums[p], self.counts[p] = x, 1
        return min(len(poor), len(donors))


def one_pass(rows: DataFrame, matrix: np.ndarray, cells: int = BLOCK_CELLS) -> Pass:
    """Assigns the vectors of `rows` (embedding) to the rows of `matrix` and adds them up."""
    shared = rows.sparkSession.sparkContext.broadcast(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value.astype(np.float64)
        sums, n, cost = np.zeros(c.shape), np.zeros(len(c), np.int64), np.zeros(len(c))
        far, farthest = np.full(len(c), -1.0), np.zeros(c.shape, np.float32)
        for b in batches:
            if not b.num_rows:
                continue
            for x, label, d in blocks(matrix_of(b.column(0)), c, cells):
                order = np.lexsort((-d, label))
                first = np.flatnonzero(np.diff(label[order], prepend=-1))
                which = label[order[first]]
                sums[which] += np.add.reduceat(x[order], first)
                n += np.bincount(label, minlength=len(c))
                cost += np.bincount(label, d, minlength=len(c))
                better = d[order[first]] > far[which]
                far[which[better]] = d[order[first]][better]
                farthest[which[better]] = x[order[first]][better]
        some = np.flatnonzero(n)
        at = pa.array(np.arange(len(some) + 1) * c.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.ListArray.from_arrays(at, pa.array(sums[some].ravel())), pa.array(n[some]), pa.array(cost[some]), pa.array(far[some]), pa.ListArray.from_arrays(at, pa.array(farthest[some].ravel()))], names=["c", "s", "n", "cost", "far", "x"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        total = matrix_of(group.column("s").combine_chunks()).sum(axis=0)
        far = group.column("far").to_numpy()
        rank = int(np.lexsort((*matrix_of(group.column("x").combine_chunks()).T[::-1], -far))[0])  # ties: the least vector
        return pa.table({"c": pa.array([key[0].as_py()], pa.int64()), "s": pa.array([total], pa.list_(pa.float64())), "n": pa.array([int(group.column("n").to_numpy().sum())]), "cost": pa.array([float(group.column("cost").to_numpy().sum())]), "far": pa.array([float(far[rank])]), "x": pa.array([group.column("x").combine_chunks()[rank].values.to_numpy()], pa.list_(pa.float32()))})

    k, dim = matrix.shape
    out = Pass(np.zeros((k, dim)), np.zeros(k, np.int64), np.full(k, -1.0), np.zeros((k, dim), np.float32), 0.0)
    for r in rows.select("embedding").mapInArrow(run, PARTS).groupBy("c").applyInArrow(add, PARTS).collect():
        out.sums[r["c"]], out.counts[r["c"]], out.far[r["c"]], out.x[r["c"]] = r["s"], r["n"], r["far"], r["x"]
        out.cost += r["cost"]
    return out


def lloyd(rows: DataFrame, matrix: np.ndarray, iterations: int, min_points: int = 0, cells: int = BLOCK_CELLS) -> tuple[np.ndarray, float]:
    """(centroids, cost of the centroids before the last update). With `min_points`, clusters of fewer members take over
    vectors of large ones after each pass, and passes go on past `iterations`, up to twice as many and ten, while that
    is needed; where vectors are alike, so that nothing is left to split, clusters may stay empty."""
    cost = float("inf")
    for done in range(2 * iterations + 10 if min_points and iterations else iterations):
        found = one_pass(rows, matrix, cells)
        cost = found.cost
        moved = found.refilled(min_points) if min_points else 0
        if done >= iterations and not moved:
            break
        new = found.means(matrix)
        if np.array_equal(new, matrix):
            break
        matrix = new
    return matrix, cost


def _uniform(seed: int, number: int):
    """A number in [0, 1) of a vector's id, for each round."""
    return F.pmod(F.xxhash64("vec_id", F.lit(seed), F.lit(number)), F.lit(1 << 53)).cast("double") / float(1 << 53)


def seeds(rows: DataFrame, nlist: int, rounds: int = 4, oversample: float = 2.0, seed: int = 42, cells: int = BLOCK_CELLS) -> np.ndarray:
    """Starting centroids by parallel seeding: in each round a vector is drawn with a probability of `oversample` * nlist times
    its share of the cost so far; the candidates (about oversample * nlist a round), weighted by the vectors that are
    nearest to them, are then thinned to nlist by weighted draws on the driver. `rows` has vec_id and embedding; draws are
    hashes of ids, so reruns agree. With fewer distinct vectors than clusters some centroids are equal."""
    scratch, number = Scratch(), 0
    start = rows.orderBy(F.xxhash64("vec_id", F.lit(seed)), "vec_id").select("embedding").first()
    if start is None:
        raise ValueError("there are no vectors to learn from")
    candidates = np.array([start[0]], np.float32)
    state, fresh = rows.select("vec_id", "embedding", F.lit(None).cast("double").alias("d")), candidates
    for number in range(rounds):
        state = scratch.table(_nearer(state, fresh, cells), "seeds")
        cost = state.agg(F.sum("d")).first()[0]
        if not cost:
            break
        drawn = state.filter(_uniform(seed, number) < oversample * nlist * F.col("d") / cost).select("embedding").collect()
        if len(scratch.made) > 1:
            scratch.drop_first()
        if not drawn:
            continue
        fresh = np.array(sorted(r[0] for r in drawn), np.float32)
        candidates = np.vstack([candidates, fresh])
    candidates = np.unique(candidates, axis=0)
    weights = one_pass(rows, candidates, cells).counts
    scratch.clear()
    return _thinned(candidates, weights, nlist, np.random.default_rng(seed))


def _nearer(state: DataFrame, fresh: np.ndarray, cells: int) -> DataFrame:
    """`state` with d, the least squared distance so far, lowered by new candidates."""
    shared = state.sparkSession.sparkContext.broadcast(fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value.astype(np.float64)
        for b in batches:
            if not b.num_rows:
                continue
            d = np.concatenate([found for _, _, found in blocks(matrix_of(b.column(1)), c, cells)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.fmin(b.column(2).to_numpy(zero_copy_only=False).astype(float), d))], names=["vec_id", "embedding", "d"])

    return state.mapInArrow(run, state.schema)


def _thinned(x: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k of the candidates by weighted squared-distance draws, then a few weighted Lloyd iterations among them."""
    y, w = x.astype(np.float64), weights.astype(float) + 1e-9
    chosen = [int(rng.choice(len(y), p=w / w.sum()))]
    d = ((y - y[chosen[0]]) ** 2).sum(axis=1)
    for _ in range(1, k):
        p = w * d
        nxt = int(rng.choice(len(y), p=p / p.sum())) if p.sum() > 0 else int(rng.integers(len(y)))
        chosen.append(nxt)
        d = np.minimum(d, ((y - y[nxt]) ** 2).sum(axis=1))
    c = y[chosen]
    for _ in range(5):
        label = np.concatenate([lab for _, lab, _ in blocks(y, c, BLOCK_CELLS)])
        total = np.zeros(c.shape)
        np.add.at(total, label, y * w[:, None])
        n = np.bincount(label, w, minlength=k)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1e-12)[:, None], c)
    return c.astype(np.float32)


def minibatch(rows: DataFrame, matrix: np.ndarray, batches: int, passes: int = 1, seed: int = 42, cells: int = BLOCK_CELLS) -> np.ndarray:
    """Centroids moved batch by batch, every vector being in one batch of each pass. A centroid's rate is the batch's share of all
    vectors it has ever got, so that it falls as they add up. Vectors are dealt to folders by hash once; a batch reads
    its own."""
    scratch = Scratch()
    dealt = scratch.parts(rows.select("embedding", F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(batches)).cast("int").alias("batch")), "batch", "batches")
    seen = np.zeros(len(matrix))
    current = matrix.astype(np.float64)
    for _ in range(passes):
        for b in range(batches):
            found = one_pass(dealt.filter(F.col("batch") == b), current.astype(np.float32), cells)
            some = found.counts > 0
            seen += found.counts
            current[some] += (found.sums[some] - found.counts[some, None] * current[some]) / seen[some, None]
    scratch.clear()
    return current.astype(np.float32)


def sampled(rows: DataFrame, most: int, seed: int) -> DataFrame:
    """About `most` of the rows, by a hash of vec_id; all of them where there are not more. They stay where they are."""
    total = rows.count()
    return rows if total <= most else rows.filter(_uniform(seed, -1) < most / total)


def fit(vectors: DataFrame, nlist: int, iterations: int = 10, n_init: int = 1, batches: int = 0, min_points: int = 0, sample_rows: int | None = None, rounds: int = 4, seed: int = 42) -> DataFrame:
    """(cluster_id, centroid): the best, by cost, of `n_init` trainings from different seeds. Each starts from parallel seeding; with
    `batches` it first goes through the vectors once in so many mini-batches, and then does Lloyd iterations. Null vectors
    are left out; with `sample_rows` it fits on about so many, taken by hash."""
    scratch = Scratch()
    rows = vectors.filter("embedding is not null").select("vec_id", "embedding")
    if sample_rows:
        rows = scratch.table(sampled(rows, sample_rows, seed), "train")
    best = None
    for run in range(n_init):
        matrix = seeds(rows, nlist, rounds, seed=seed + run)
        if batches:
            matrix = minibatch(rows, matrix, batches, seed=seed + run)
        matrix, _ = lloyd(rows, matrix, iterations, min_points)
        cost = one_pass(rows, matrix).cost
        if best is None or cost < best[0]:
            best = cost, matrix
    scratch.clear()
    return vectors.sparkSession.createDataFrame([(i, v.tolist()) for i, v in enumerate(best[1])], "cluster_id long, centroid array<float>")


def cost(vectors: DataFrame, centroids: DataFrame) -> float:
    """Sum of squared distances to the nearest centroid."""
    matrix = np.array([r["centroid"] for r in centroids.orderBy("cluster_id").collect()], np.float32)
    return one_pass(vectors.filter("embedding is not null"), matrix).cost
