"""Product quantization: training, encoding, distance tables, scans by code."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecloom.functions.distance import fold_l2, l2
from vecloom.operators.ivf import first_by_digest, kmeans


def subdim_of(dim: int, m: int) -> int:
    if m < 1 or dim % m:
        raise ValueError(f"{dim} dimensions can't be cut into {m} equal parts")
    return dim // m


def subvectors(vectors: DataFrame, m: int, dim: int, vector_col: str = "embedding") -> DataFrame:
    """(vec_id, part, sub): the m equal parts of each vector."""
    n = subdim_of(dim, m)
    parts = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda p: F.slice(F.col(vector_col), p * n + 1, F.lit(n)))
    return vectors.select("vec_id", F.posexplode(parts).alias("part", "sub"))


def sample_codebooks(vectors: DataFrame, m: int, dim: int, ksub: int = 256) -> DataFrame:
    """(part, code, centroid): the parts of `ksub` vectors of the data."""
    n = subdim_of(dim, m)
    parts = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda p: F.slice(F.col("embedding"), p * n + 1, F.lit(n)))
    return first_by_digest(vectors, ksub).select("ordinal", F.posexplode(parts).alias("part", "centroid")).select("part", F.col("ordinal").alias("code"), "centroid")


def train(vectors: DataFrame, m: int, dim: int, ksub: int = 256, iterations: int = 10, sample_rows: int | None = None, seed: int = 42) -> DataFrame:
    """(part, code, centroid) by k-means over each part, with seed + part."""
    n, out = subdim_of(dim, m), None
    for part in range(m):
        cut = vectors.filter("embedding is not null").select("vec_id", F.slice("embedding", part * n + 1, n).alias("embedding"))
        found = kmeans(cut, ksub, iterations, sample_rows=sample_rows, seed=seed + part).select(F.lit(part).alias("part"), F.col("cluster_id").cast("int").alias("code"), "centroid")
        out = found if out is None else out.unionByName(found)
    return out


def codebook_array(codebooks: DataFrame) -> np.ndarray:
    """(m, ksub, subdim) on the driver; ksub is at most 256, so its size is bounded by the vectors' length."""
    rows = codebooks.collect()
    m, ksub = max(r["part"] for r in rows) + 1, max(r["code"] for r in rows) + 1
    if ksub > 256 or len(rows) != m * ksub:
        raise ValueError("a codebook has up to 256 codes, the same number for each part")
    out = np.zeros((m, ksub, len(rows[0]["centroid"])), np.float32)
    for r in rows:
        out[r["part"], r["code"]] = r["centroid"]
    return out


def encode(vectors: DataFrame, codebooks: DataFrame) -> DataFrame:
    """(vec_id, codes): for each part the nearest code, lowest on ties. No shuffle."""
    book = codebook_array(codebooks)
    m, _, n = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            codes = np.stack([fold_l2(x[:, p * n : (p + 1) * n], book[p]).argmin(axis=1) for p in range(m)], axis=1).astype(np.int16)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, m, dtype=np.int32)), pa.array(codes.ravel()))], names=["vec_id", "codes"])

    subdim_of(m * n, m)
    return vectors.select("vec_id", "embedding").filter("embedding is not null").mapInArrow(run, "vec_id long, codes array<smallint>")


def adc_tables(queries: DataFrame, codebooks: DataFrame, m: int, dim: int) -> DataFrame:
    """(qid, part, code, dist): squared distance of each query's part to each code of it."""
    n = subdim_of(dim, m)
    parts = F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda p: F.slice("q", p * n + 1, F.lit(n)))
    split = queries.select("qid", F.posexplode(parts).alias("part", "sub"))
    return split.join(F.broadcast(codebooks), "part").select("qid", F.col("part").cast("long").alias("part"), F.col("code").cast("long").alias("code"), l2(F.col("sub"), F.col("centroid")).alias("dist"))


def adc_arrays(tables: DataFrame) -> DataFrame:
    """(qid, adc): each query's distances as an array of arrays, part by part."""
    rows = tables.groupBy("qid", "part").agg(F.array_sort(F.collect_list(F.struct("code", "dist"))).alias("c")).select("qid", "part", F.col("c.dist").alias("d"))
    return rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("part", "d"))).alias("p")).select("qid", F.col("p.d").alias("adc"))


def adc_distance(adc: Column, codes: Column) -> Column:
    """Sum over the parts of the table entries that the codes name."""
    return F.aggregate(F.zip_with(adc, codes, lambda t, c: F.get(t, c.cast("int"))), F.lit(0.0), lambda s, v: s + v)
