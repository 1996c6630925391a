"""Binary vector files and model files: readers and writers.

Files that grow with the vectors (records, labels, codes, members) are data sources (`vecloom.sources.binary`); records in
stores that only Spark can open are read as its fixed-length binary records. Model files, whose size is bounded by the
number of clusters, are parsed whole. All integers and floats are little-endian.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.sources import binary

MAGIC_CODEBOOKS = 0x47515049  # fixed value of the format


def _size_and_dim(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(file, bytes, first integer) for each file of a path, by Spark's own file access."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(sc._jsc.hadoopConfiguration())
    out = []
    for status in fs.globStatus(target) or []:
        for s in fs.listStatus(status.getPath()) if status.isDirectory() else [status]:
            name, size = s.getPath().toString(), s.getLen()
            if s.getPath().getName().startswith(("_", ".")):
                continue
            if size < 4:
                raise ValueError(f"{name} is empty")
            stream = fs.open(s.getPath())
            head = bytes(stream.read() & 0xFF for _ in range(4))
            stream.close()
            out.append((name, size, struct.unpack("<i", head)[0]))
    if not out:
        raise FileNotFoundError(path)
    return sorted(out)


def _records(spark: SparkSession, path: str, expected_dim: int | None, kind: str, value: str) -> DataFrame:
    files = _size_and_dim(spark, path)
    dim = files[0][2]
    for name, size, d in files:
        if d <= 0:
            raise ValueError(f"{name}: {d} dimensions")
        if d != dim or (expected_dim is not None and d != expected_dim):
            raise ValueError(f"{name}: {d} dimensions, not {expected_dim or dim}")
        if size % (4 + 4 * d):
            raise ValueError(f"{name}: its size is no multiple of a record's")
    width = 4 + 4 * dim
    # binaryRecords is the one splittable reader of such files; rows become columns at once
    raw = None
    for number, (name, _, _) in enumerate(files):
        part = spark.sparkContext.binaryRecords(name, width).zipWithIndex().map(lambda x, n=number: (n, x[1], bytearray(x[0])))
        raw = part if raw is None else raw.union(part)
    counts = np.cumsum([0, *[size // width for _, size, _ in files]]).tolist()
    frame = spark.createDataFrame(raw, "file int, at long, raw binary")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            rows = np.frombuffer(b"".join(b["raw"]), np.uint8).reshape(-1, width)
            if (rows[:, :4].copy().view("<i4").ravel() != dim).any():
                raise ValueError(f"a record has other than {dim} dimensions")
            yield pd.DataFrame({"id": b["at"].to_numpy() + np.array(counts)[b["file"].to_numpy()], value: list(rows[:, 4:].copy().view("<f4" if kind == "float" else "<i4"))})

    return frame.mapInPandas(decode, f"id long, {value} array<{kind}>")


def _by_arrow(path: str) -> bool:
    """Whether executors can open the path themselves; else Spark reads it (other stores, slower)."""
    try:
        return bool(binary.filesystem(path))
    except (pa.ArrowException, OSError, ValueError):
        return False


def read_fvecs(spark: SparkSession, path: str, expected_dim: int | None = None) -> DataFrame:
    """(vec_id, embedding): ids count rows from 0, file by file in order of their names. Raises for an empty file, a size
    that is no multiple of a record's, and rows of another length."""
    if _by_arrow(path):
        return binary.read(spark, "fvecs", path, expected_dim)
    return _records(spark, path, expected_dim, "float", "embedding").withColumnRenamed("id", "vec_id")


def read_ivecs(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """(qid, gt): qid counts rows from 1; the first k ids of each, or all."""
    if _by_arrow(path):
        rows = binary.read(spark, "ivecs", path)
    else:
        rows = _records(spark, path, None, "int", "gt").select((F.col("id") + 1).alias("qid"), "gt")
    return rows.withColumn("gt", F.slice("gt", 1, k)) if k else rows


def write_fvecs(vectors: DataFrame, path: str) -> None:
    """Writes (vec_id, embedding) in ascending order of vec_id to one file, all tasks at once."""
    binary.write(vectors, "fvecs", path, ["vec_id"], "embedding")


def write_ivecs(truth: DataFrame, path: str) -> None:
    """Writes (qid, gt) in ascending order of qid."""
    binary.write(truth, "ivecs", path, ["qid"], "gt")


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A whole model file: centroids, codebooks and headers are bounded by the number of clusters."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()["content"])


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(data))
    stream.close()


def _exact(data: bytes, size: int, what: str) -> None:
    if len(data) != size:
        raise ValueError(f"{what}: {len(data)} bytes, not {size}")


def parse_centroids(data: bytes, dim: int | None = None) -> np.ndarray:
    n, d = struct.unpack_from("<II", data)
    if not d or (dim is not None and d != dim):
        raise ValueError(f"centroids have {d} dimensions, not {dim}")
    _exact(data, 8 + 4 * n * d, "centroids")
    return np.frombuffer(data, "<f4", offset=8).reshape(n, d)


def format_centroids(matrix: np.ndarray) -> bytes:
    return struct.pack("<II", *matrix.shape) + matrix.astype("<f4").tobytes()


def parse_u32_list(data: bytes, n: int | None = None) -> np.ndarray:
    """Labels and sorted ids: a count, and so many unsigned integers."""
    (count,) = struct.unpack_from("<I", data)
    if n is not None and count != n:
        raise ValueError(f"{count} entries, not {n}")
    _exact(data, 4 + 4 * count, "list")
    return np.frombuffer(data, "<u4", offset=4).astype(np.int64)


def format_u32_list(values: np.ndarray) -> bytes:
    return struct.pack("<I", len(values)) + np.asarray(values).astype("<u4").tobytes()


def parse_members(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of overlapping lists; offsets begin at 0, never fall, and end at the total."""
    n, total = struct.unpack_from("<QQ", data)
    _exact(data, 16 + 8 * (n + 1) + 4 * total, "members")
    offsets = np.frombuffer(data, "<u8", n + 1, 16).astype(np.int64)
    if offsets[0] or (np.diff(offsets) < 0).any() or offsets[-1] != total or total > 0xFFFFFFFF:
        raise ValueError("offsets of members are damaged")
    return offsets, np.frombuffer(data, "<u4", total, 16 + 8 * (n + 1)).astype(np.int64)


def format_members(offsets: np.ndarray, ids: np.ndarray) -> bytes:
    return struct.pack("<QQ", len(offsets) - 1, len(ids)) + offsets.astype("<u8").tobytes() + ids.astype("<u4").tobytes()


def parse_codebooks(data: bytes) -> np.ndarray:
    """(m, ksub, subdim)."""
    magic, dim, m, ksub, subdim, nbits = struct.unpack_from("<6I", data)
    if magic != MAGIC_CODEBOOKS or m * subdim != dim or not 1 <= ksub <= 256 or nbits != 8:
        raise ValueError("the header of the codebooks is damaged")
    _exact(data, 24 + 4 * m * ksub * subdim, "codebooks")
    return np.frombuffer(data, "<f4", offset=24).reshape(m, ksub, subdim)


def format_codebooks(book: np.ndarray) -> bytes:
    m, ksub, subdim = book.shape
    return struct.pack("<6I", MAGIC_CODEBOOKS, m * subdim, m, ksub, subdim, 8) + book.astype("<f4").tobytes()


def parse_codes(data: bytes) -> np.ndarray:
    n, m = struct.unpack_from("<II", data)
    _exact(data, 8 + n * m, "codes")
    return np.frombuffer(data, np.uint8, offset=8).reshape(n, m)


def format_codes(codes: np.ndarray) -> bytes:
    return struct.pack("<II", *codes.shape) + codes.astype(np.uint8).tobytes()


def save_pca(spark: SparkSession, path: str, model) -> None:
    """A model folder: mean, components, explained variance as binary files, and their description."""
    write_bytes(spark, f"{path}/mean.bin", struct.pack("<I", len(model.mean)) + model.mean.astype("<f4").tobytes())
    write_bytes(spark, f"{path}/components.bin", format_centroids(model.components))
    write_bytes(spark, f"{path}/explained_variance.bin", struct.pack("<I", len(model.explained_variance)) + model.explained_variance.astype("<f4").tobytes())
    write_bytes(spark, f"{path}/meta.bin", struct.pack("<III", len(model.components), len(model.mean), int(model.whiten)))
    write_bytes(spark, f"{path}/model.json", json.dumps({"n_components": len(model.components), "original_dim": len(model.mean), "whiten": model.whiten}).encode())


def load_pca(spark: SparkSession, path: str):
    from vecloom.operators.pca import PcaModel

    n, dim, whiten = struct.unpack("<III", read_bytes(spark, f"{path}/meta.bin"))
    mean, variance = read_bytes(spark, f"{path}/mean.bin"), read_bytes(spark, f"{path}/explained_variance.bin")
    _exact(mean, 4 + 4 * dim, "mean")
    _exact(variance, 4 + 4 * n, "explained variance")
    components = parse_centroids(read_bytes(spark, f"{path}/components.bin"), dim)
    if len(components) != n:
        raise ValueError("shapes of the model don't fit")
    return PcaModel(np.frombuffer(mean, "<f4", offset=4).astype(float), components.astype(float), np.frombuffer(variance, "<f4", offset=4).astype(float), bool(whiten))


def load_pca_npz(path: str):
    """A model in numpy's archive with mean, components, explained_variance, n_components, original_dim, whiten."""
    from vecloom.operators.pca import PcaModel

    with np.load(path) as z:
        missing = {"mean", "components", "explained_variance", "n_components", "original_dim", "whiten"} - set(z.files)
        if missing:
            raise ValueError(f"{path} lacks {', '.join(sorted(missing))}")
        model = PcaModel(z["mean"], z["components"], z["explained_variance"], bool(z["whiten"]))
        if model.components.shape != (int(z["n_components"]), int(z["original_dim"])):
            raise ValueError("shapes of the model don't fit")
    return model


def save_pca_npz(path: str, model) -> None:
    np.savez(path, mean=model.mean, components=model.components, explained_variance=model.explained_variance, n_components=len(model.components), original_dim=len(model.mean), whiten=model.whiten)
