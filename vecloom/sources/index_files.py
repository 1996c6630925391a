"""Cluster metadata files: headers, cluster entries, centroids. Little-endian; read and written whole, as their size is
bounded by the number of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

# Magic numbers.
SINGLE, PLACED, SHARDED, QUANTIZED = 0x49564633, 0x49563443, 0x49564634, 0x4751504D
# Fields of the headers, in order.
_START = [("magic", "<u4"), ("version", "<u4"), ("dim", "<u4")]
_SIZES = [("vectors_per_lba", "<u4"), ("nlist", "<u4"), ("num_vectors", "<u4"), ("sector_size", "<u4"), ("base_lba", "<u8")]
HEADERS = {
    SINGLE: np.dtype([*_START, ("shard_dim", "<u4"), *_SIZES]),
    PLACED: np.dtype([*_START, ("num_shards", "<u4"), *_SIZES]),
    SHARDED: np.dtype([*_START, ("num_shards", "<u4"), ("shard_dims", "<u4", 4), ("shard_offsets", "<u4", 4), ("shard_bytes", "<u4", 4), *_SIZES]),
    QUANTIZED: np.dtype([
        *_START, ("nlist", "<u4"), ("num_vectors", "<u4"), ("num_disks", "<u4"), ("sector_size", "<u4"), ("pq_m", "<u4"), ("pq_ksub", "<u4"), ("pq_nbits", "<u4"), ("pq_subdim", "<u4"),
        ("pq_code_bytes", "<u4"), ("pq_codes_per_lba", "<u4"), ("raw_vectors_per_lba", "<u4"), ("base_lba", "<u8"), ("raw_region_lba", "<u8", 4),
    ]),
}
# Fields of the cluster entries; those named pad are the gaps of an aligned layout.
ENTRIES = {
    SINGLE: [("cluster_id", "<u4"), ("start_lba", "<u8"), ("num_vectors", "<u4"), ("num_lbas", "<u4")],
    PLACED: [("cluster_id", "<u4"), ("disk_id", "<u4"), ("start_lba", "<u8"), ("num_vectors", "<u4"), ("num_lbas", "<u4")],
    SHARDED: [("cluster_id", "<u4"), ("pad", "<u4"), ("start_lba", "<u8"), ("num_vectors", "<u4"), ("num_lbas", "<u4")],
    QUANTIZED: [("cluster_id", "<u4"), ("disk_id", "<u4"), ("pq_start_lba", "<u8"), ("pq_num_lbas", "<u4"), ("pad", "<u4"), ("raw_start_lba", "<u8"), ("raw_num_lbas", "<u4"), ("num_vectors", "<u4"), ("sorted_id_base", "<u4"), ("pad2", "<u4")],
}
INLINE = (SINGLE, PLACED)  # formats with each centroid behind its entry; the others have all centroids behind all entries


def _entry(magic: int, dim: int) -> np.dtype:
    return np.dtype([*ENTRIES[magic], ("centroid", "<f4", dim)] if magic in INLINE else ENTRIES[magic])


def _check(header: dict, clusters: np.ndarray) -> None:
    magic = header["magic"]
    if not header["dim"] or not header["nlist"]:
        raise ValueError("the header has no dimensions or no clusters")
    if magic == SHARDED:
        if header["version"] not in (1, 2):
            raise ValueError(f"version {header['version']} is unknown")
        if not 1 <= header["num_shards"] <= 4 or not header["vectors_per_lba"] or min(header["shard_vectors_per_lba"][: header["num_shards"]]) < 1:
            raise ValueError("the header's shards are damaged")
    if magic == QUANTIZED and (header["pq_m"] * header["pq_subdim"] != header["dim"] or header["pq_code_bytes"] != header["pq_m"] or header["num_disks"] != 4 or not header["pq_ksub"]):
        raise ValueError("the header's codes are damaged")
    if (clusters["cluster_id"] != np.arange(len(clusters))).any():
        raise ValueError("clusters are not numbered in order")
    if "disk_id" in clusters.dtype.names and (clusters["disk_id"] >= 4).any():
        raise ValueError("a cluster is on no disk")


def parse(data: bytes) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray | None]:
    """(header, cluster entries, centroids, codebooks or None) of any of the four formats. Raises for an unknown magic number
    or version, headers that contradict themselves, clusters out of order, and files too short or long."""
    magic = int.from_bytes(data[:4], "little")
    if magic not in HEADERS:
        raise ValueError(f"{magic:#x} is no known kind of file")
    kind = HEADERS[magic]
    if len(data) < kind.itemsize:
        raise ValueError("the file is too short")
    raw = np.frombuffer(data, kind, 1)[0]
    header = {n: raw[n].tolist() for n in kind.names}
    at = kind.itemsize
    if magic == SHARDED:
        per = np.frombuffer(data, "<u4", 4, at).tolist() if header["version"] == 2 and len(data) >= at + 16 else [header["vectors_per_lba"]] * 4
        header["shard_vectors_per_lba"] = per
        at += 16 * (header["version"] == 2)
    entry, n, dim = _entry(magic, header["dim"]), header["nlist"], header["dim"]
    size = at + n * entry.itemsize + (0 if magic in INLINE else 4 * n * dim)
    size += 4 * header["pq_ksub"] * dim if magic == QUANTIZED else 0
    if len(data) != size:
        raise ValueError(f"{len(data)} bytes, not {size}")
    clusters = np.frombuffer(data, entry, n, at)
    _check(header, clusters)
    at += n * entry.itemsize
    centroids = clusters["centroid"] if magic in INLINE else np.frombuffer(data, "<f4", n * dim, at).reshape(n, dim)
    books = np.frombuffer(data, "<f4", header["pq_ksub"] * dim, at + 4 * n * dim).reshape(header["pq_m"], header["pq_ksub"], -1) if magic == QUANTIZED else None
    return header, clusters, centroids, books


def build(header: dict, clusters: list[dict], centroids: np.ndarray, codebooks: np.ndarray | None = None) -> bytes:
    """The file of a header, cluster entries and centroids."""
    magic = header["magic"]
    kind, entry = HEADERS[magic], _entry(magic, header["dim"])
    head = np.zeros(1, kind)
    for name in kind.names:
        value = header.get(name, 0)
        head[name][0] = [*value, 0, 0, 0, 0][:4] if isinstance(value, list | tuple) else value
    rows = np.zeros(len(clusters), entry)
    for i, c in enumerate(clusters):
        for name in entry.names:
            if name in c:
                rows[name][i] = c[name]
    out = head.tobytes()
    if magic == SHARDED and header["version"] == 2:
        out += np.array([*header["shard_vectors_per_lba"], 0, 0, 0, 0][:4], "<u4").tobytes()
    if magic in INLINE:
        rows["centroid"] = centroids
        return out + rows.tobytes()
    out += rows.tobytes() + np.asarray(centroids, "<f4").tobytes()
    return out + (np.asarray(codebooks, "<f4").tobytes() if codebooks is not None else b"")


def clusters_frame(spark: SparkSession, clusters: np.ndarray) -> DataFrame:
    """Cluster entries as rows, with sorted_id_base as the running sum of sizes where the file lacks it."""
    names = [n for n in clusters.dtype.names if not n.startswith("pad") and n != "centroid"]
    frame = pd.DataFrame({n: clusters[n].astype(np.int64) for n in names})
    if "sorted_id_base" not in frame:
        frame["sorted_id_base"] = frame["num_vectors"].cumsum() - frame["num_vectors"]
    return spark.createDataFrame(frame)
