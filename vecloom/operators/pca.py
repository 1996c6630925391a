"""Principal components: fit and transform."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.functions.distance import dot, safe_sqrt


@dataclass
class PcaModel:
    """mean (d), components (r, d), explained variance (r), whether transforms are whitened."""

    mean: np.ndarray
    components: np.ndarray
    explained_variance: np.ndarray
    whiten: bool = False

    def __post_init__(self) -> None:
        if self.components.ndim != 2 or self.components.shape[1] != len(self.mean) or len(self.explained_variance) != len(self.components):
            raise ValueError("shapes of the model don't fit")


def fit(vectors: DataFrame, n_components: int | None = None, whiten: bool = False, vector_col: str = "embedding") -> PcaModel:
    """From sums and products made per task (d * d numbers, whatever the rows); variances divide by n - 1. The sign of a
    component makes its largest entry positive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s, p = 0, None, None
        for b in batches:
            lists = b.column(0)
            size = int(np.diff(lists.offsets.to_numpy()[:2])[0])
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
            n, s, p = n + len(x), (0 if s is None else s) + x.sum(0), (0 if p is None else p) + x.T @ x
        if n:
            flat = np.concatenate([[n], s, p.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "v"])

    rows = vectors.select(vector_col).filter(F.col(vector_col).isNotNull()).mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(len(rows))
    for r in rows:
        flat[r["at"]] = r["v"]
    d = int(round((np.sqrt(4 * len(flat) - 3) - 1) / 2))
    n, mean = flat[0], flat[1 : d + 1] / flat[0]
    cov = (flat[d + 1 :].reshape(d, d) - n * np.outer(mean, mean)) / max(1.0, n - 1)
    values, columns = np.linalg.eigh(cov)
    order = np.argsort(-values)[: n_components or d]
    components = columns[:, order].T
    components *= np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)])[:, None]
    return PcaModel(mean, components, np.maximum(values[order], 0), whiten)


GROUPS = 64  # first level of adding up what tasks send


def _blocks(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def _moments(rows: DataFrame) -> tuple[int, np.ndarray]:
    """Number and mean of the vectors (embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, None
        for b in batches:
            if b.num_rows:
                x = _blocks(b.column(0)).astype(np.float64)
                n, s = n + len(x), x.sum(axis=0) if s is None else s + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(s) + 1)), pa.array(np.append(s, n))], names=["at", "v"])

    found = rows.mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    if not found:
        raise ValueError("there are no vectors to learn from")
    flat = np.array([r["v"] for r in found])
    return int(flat[-1]), flat[:-1] / flat[-1]


def _range_pass(rows: DataFrame, mean: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, P) for Z = (X - mean) v, of so many rows as there are vectors and so many columns as v has: R of Z's QR decomposition,
    made of those of tall blocks, and P = (X - mean)^T Z. A task sends two matrices as wide as v."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, v))
    dim, r = v.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, v = shared.value
        triangle, product = np.zeros((0, r)), np.zeros((dim, r))
        for b in batches:
            if not b.num_rows:
                continue
            x = _blocks(b.column(0)).astype(np.float64) - mean
            z = x @ v
            triangle = np.linalg.qr(np.vstack([triangle, z]), mode="r")
            product += x.T @ z
        if len(triangle):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % GROUPS]), pa.array([triangle.ravel()]), pa.array([product.ravel()])], names=["g", "t", "p"])

    def add(key: tuple, group: pa.Table) -> pa.Table:
        triangle = np.linalg.qr(np.concatenate([np.reshape(t, (-1, r)) for t in group.column("t").to_pylist()]), mode="r")
        product = np.sum([np.array(p) for p in group.column("p").to_pylist()], axis=0)
        return pa.table({"g": pa.array([0], pa.int64()), "t": pa.array([triangle.ravel()], pa.list_(pa.float64())), "p": pa.array([product], pa.list_(pa.float64()))})

    kind = "g long, t array<double>, p array<double>"
    few = rows.mapInArrow(run, kind).groupBy("g").applyInArrow(add, kind)
    (one,) = few.groupBy("g").applyInArrow(add, kind).collect()
    return np.reshape(one["t"], (-1, r)), np.reshape(one["p"], (dim, r))


def fit_randomized(vectors: DataFrame, n_components: int, whiten: bool = False, oversample: int = 10, passes: int = 4, seed: int = 42, vector_col: str = "embedding") -> PcaModel:
    """`fit` for long vectors: a random range of n_components + oversample directions, and what up to `passes` over the vectors turn
    it into one after the other, are decomposed together. What tasks send and the driver holds is as wide as these
    ranges, 1 + `passes` of them; no matrix of dimensions by dimensions is made."""
    rows = vectors.select(F.col(vector_col).alias("embedding")).filter("embedding is not null")
    n, mean = _moments(rows)
    if not 1 <= n_components <= len(mean):
        raise ValueError(f"between 1 and {len(mean)} components can be made, not {n_components}")
    dim = len(mean)
    block = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, min(dim, n_components + oversample))))[0]
    basis = block
    for _ in range(passes):
        if basis.shape[1] == dim:
            break
        _, more = _range_pass(rows, mean, block)
        scale = np.abs(more).max()
        for _ in range(2):  # twice, against rounding
            more -= basis @ (basis.T @ more)
        q, t = np.linalg.qr(more)
        block = q[:, np.abs(np.diag(t)) > 1e-10 * max(scale, 1e-300)][:, : dim - basis.shape[1]]
        if not block.shape[1]:  # the vectors lie in what has been found
            break
        basis = np.linalg.qr(np.hstack([basis, block]))[0]
    triangle, _ = _range_pass(rows, mean, basis)
    _, s, w = np.linalg.svd(triangle)
    components = (basis @ w.T).T[:n_components]
    variance = np.zeros(basis.shape[1])
    variance[: len(s)] = s**2 / max(1, n - 1)
    components *= np.sign(components[np.arange(len(components)), np.abs(components).argmax(1)])[:, None]
    return PcaModel(mean, components, variance[:n_components], whiten)


def rotate(vectors: DataFrame, basis: DataFrame, mean: DataFrame, variance: DataFrame | None = None) -> DataFrame:
    """(vec_id, rotated) by tables: basis (component, weights), mean (mean ARRAY), variance (variance ARRAY). One row each but
    the basis, which has one row a component and is sent as one array."""
    model = basis.agg(F.array_sort(F.collect_list(F.struct("component", "weights"))).alias("b")).select(F.col("b.weights").alias("rows")).crossJoin(mean)
    joined = vectors.crossJoin(F.broadcast(model))
    centred = F.zip_with("embedding", "mean", lambda x, m: x.cast("double") - m)
    out = F.transform(F.array(centred), lambda x: F.transform("rows", lambda c: dot(x, c)))[0]
    if variance is not None:
        joined = joined.crossJoin(F.broadcast(variance))
        out = F.zip_with(out, "variance", lambda x, v: x / safe_sqrt(v))
    return joined.select("vec_id", out.alias("rotated"))


def transform_rows(vectors: DataFrame, model: PcaModel) -> DataFrame:
    """(vec_id, rotated) by matrix products over Arrow batches; for whole tables."""
    scale = np.where(model.explained_variance > 0, np.sqrt(np.maximum(model.explained_variance, 1e-300)), 1.0) if model.whiten else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            y = (x - model.mean) @ model.components.T
            y = y / scale if scale is not None else y
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, y.size + 1, y.shape[1], dtype=np.int32)), pa.array(y.ravel()))], names=["vec_id", "rotated"])

    return vectors.select("vec_id", "embedding").filter("embedding is not null").mapInArrow(run, "vec_id long, rotated array<double>")
