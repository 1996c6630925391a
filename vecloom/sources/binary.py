"""Vector files and index files as Spark data sources, read and written in parallel by byte ranges.

Formats, all little-endian: `fvecs` and `ivecs` (records of a count and so many values), `u32list` (a count and integers:
labels, sorted ids), `pqcodes` (rows, bytes a row, codes) and `vecmembers` (overlapping lists: offsets, then ids). A path is
a file, a folder of files or a pattern of names, on any file system that Arrow can open on the executors; the files of a
folder follow one another by name. `spark.read.format("fvecs").load(path)` after `register(spark)`.

What goes through the driver is a number of ranges: of the size of the file over `split_bytes`.
"""

from __future__ import annotations

import fnmatch
import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from vecloom.sources.shared import discard, table

SPLIT_BYTES = 64 << 20
BATCH_BYTES = 4 << 20
MOST_IDS = 0xFFFFFFFF


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it. Raises where Arrow has none for it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files that a path names, by name; hidden ones left out."""
    fs, inner = filesystem(path)
    info = fs.get_file_info(inner)
    if info.type == pafs.FileType.File:
        return [(inner, info.size)]
    folder, pattern = (inner, "*") if info.type == pafs.FileType.Directory else posixpath.split(inner)
    if fs.get_file_info(folder).type != pafs.FileType.Directory:
        raise FileNotFoundError(path)
    found = [f for f in fs.get_file_info(pafs.FileSelector(folder)) if f.type == pafs.FileType.File and f.base_name[0] not in "._" and fnmatch.fnmatch(f.base_name, pattern)]
    if not found:
        raise FileNotFoundError(path)
    return sorted((f.path, f.size) for f in found)


def _head(path: str, file: str, n: int) -> bytes:
    with filesystem(path)[0].open_input_file(file) as f:
        return f.read_at(n, 0)


@dataclass
class Range(InputPartition):
    """`count` records of `width` bytes from byte `start` of a file, the first of them number `first`."""

    file: str
    start: int
    count: int
    width: int
    first: int
    cluster: int = 0


def _cut(file: str, start: int, count: int, width: int, first: int, split: int) -> Iterator[Range]:
    step = max(1, split // max(width, 1))
    for at in range(0, count, step):
        yield Range(file, start + at * width, min(step, count - at), width, first + at)


def _size(name: str, size: int, want: int) -> None:
    if size != want:
        raise ValueError(f"{name}: {size} bytes, not {want}")


def record_ranges(path: str, expected: int | None = None, split: int = SPLIT_BYTES) -> list[Range]:
    """Ranges of fvecs and ivecs files. Raises for an empty file, a count that is not positive, differs from file to file or
    from `expected`, and a size that is no multiple of a record's."""
    out, first, dim = [], 0, expected
    for name, size in files_of(path):
        if size < 4:
            raise ValueError(f"{name} is empty")
        (d,) = struct.unpack("<i", _head(path, name, 4))
        if d <= 0:
            raise ValueError(f"{name}: {d} dimensions")
        dim = dim or d
        if d != dim:
            raise ValueError(f"{name}: {d} dimensions, not {dim}")
        if size % (4 + 4 * d):
            raise ValueError(f"{name}: its size is no multiple of a record's")
        out += _cut(name, 0, size // (4 + 4 * d), 4 + 4 * d, first, split)
        first += size // (4 + 4 * d)
    return out


def list_ranges(path: str, expected: int | None = None, split: int = SPLIT_BYTES) -> list[Range]:
    out, first = [], 0
    for name, size in files_of(path):
        if size < 4:
            raise ValueError(f"{name} is empty")
        (n,) = struct.unpack("<I", _head(path, name, 4))
        _size(name, size, 4 + 4 * n)
        out += _cut(name, 4, n, 4, first, split)
        first += n
    if expected is not None and first != expected:
        raise ValueError(f"{first} entries, not {expected}")
    return out


def code_ranges(path: str, expected: int | None = None, split: int = SPLIT_BYTES) -> list[Range]:
    out, first = [], 0
    for name, size in files_of(path):
        if size < 8:
            raise ValueError(f"{name} is empty")
        n, m = struct.unpack("<II", _head(path, name, 8))
        if expected is not None and m != expected:
            raise ValueError(f"{name}: {m} bytes a row, not {expected}")
        _size(name, size, 8 + n * m)
        out += _cut(name, 8, n, m, first, split)
        first += n
    return out


def member_ranges(path: str, expected: int | None = None, split: int = SPLIT_BYTES) -> list[Range]:
    """Ranges of ids, each with the list that its first id is in. Offsets are read in pieces and checked: they begin at 0, never
    fall and end at the total. A range may begin within a list, so a list of any length is cut."""
    ((name, size),) = files_of(path)
    if size < 16:
        raise ValueError(f"{name} is empty")
    n, total = struct.unpack("<QQ", _head(path, name, 16))
    if n > size or total > MOST_IDS:
        raise ValueError("offsets of members are damaged")
    _size(name, size, 16 + 8 * (n + 1) + 4 * total)
    if expected is not None and n != expected:
        raise ValueError(f"{n} lists, not {expected}")
    base, step = 16 + 8 * (n + 1), max(1, split // 4)
    cuts, before = np.arange(0, total, step, dtype=np.uint64), np.uint64(0)
    owner = np.zeros(len(cuts), np.int64)
    with filesystem(path)[0].open_input_file(name) as f:
        for at in range(0, n + 1, BATCH_BYTES // 8):
            piece = np.frombuffer(f.read_at(8 * min(BATCH_BYTES // 8, n + 1 - at), 16 + 8 * at), "<u8")
            if (at == 0 and piece[0]) or piece[0] < before or (piece[1:] < piece[:-1]).any():
                raise ValueError("offsets of members are damaged")
            owner += np.searchsorted(piece, cuts, "right")  # offsets up to the cut: the last of them is its list's
            before = piece[-1]
    if before != total:
        raise ValueError("offsets of members are damaged")
    return [Range(name, base + 4 * int(c), min(step, total - int(c)), 4, int(c), int(o) - 1) for c, o in zip(cuts, owner, strict=True)]


class _Reader(DataSourceReader):
    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.expected = int(options["expected"]) if "expected" in options else None

    def partitions(self) -> list[Range]:
        return KINDS[self.kind][1](self.path, self.expected, self.split) or [Range("", 0, 0, 1, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.count:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(part.file) as f:
            step = max(1, BATCH_BYTES // part.width)
            for at in range(0, part.count, step):
                n = min(step, part.count - at)
                raw = f.read_at(n * part.width, part.start + at * part.width)
                if len(raw) != n * part.width:
                    raise ValueError(f"{part.file} is too short")
                ids = part.first + at + np.arange(n)
                if self.kind == "vecmembers":
                    yield self._members(f, np.frombuffer(raw, "<u4"), ids, part)
                    continue
                data = np.frombuffer(raw, np.uint8).reshape(n, part.width)
                yield self._decoded(data, ids, part)

    def _decoded(self, data: np.ndarray, ids: np.ndarray, part: Range) -> pa.RecordBatch:
        if self.kind == "u32list":
            values = pa.array(data.view("<u4").ravel().astype(np.int64))
        elif self.kind == "pqcodes":
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, data.size + 1, part.width, dtype=np.int32)), pa.array(data.ravel().astype(np.int16)))
        else:
            dim = part.width // 4 - 1
            words = data.view("<i4")
            if (words[:, 0] != dim).any():
                raise ValueError(f"a record of {part.file} has other than {dim} dimensions")
            body = np.ascontiguousarray(words[:, 1:]).ravel().view("<f4" if self.kind == "fvecs" else "<i4")
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, body.size + 1, dim, dtype=np.int32)), pa.array(body))
        return pa.RecordBatch.from_arrays([pa.array(ids + (self.kind == "ivecs")), values], names=KINDS[self.kind][0].replace(",", " ").split()[::2])

    def _members(self, f, ids: np.ndarray, places: np.ndarray, part: Range) -> pa.RecordBatch:
        """Each id's list and its place in it, from the offsets of the lists that these ids are in."""
        lo, found, last = part.cluster, [], int(places[-1])
        in_file = (part.start - 4 * part.first - 16) // 8
        while not found or found[-1][-1] <= last:  # offsets of the lists from the range's first on, until they pass the last id
            n = min(BATCH_BYTES // 8, in_file - lo - len(found) * (BATCH_BYTES // 8))
            if n <= 0:
                break
            found.append(np.frombuffer(f.read_at(8 * n, 16 + 8 * (lo + len(found) * (BATCH_BYTES // 8))), "<u8").astype(np.int64))
        offsets = np.concatenate(found)
        at = np.searchsorted(offsets, places, "right") - 1
        return pa.RecordBatch.from_arrays([pa.array(lo + at), pa.array(places - offsets[at]), pa.array(ids.astype(np.int64))], names=["cluster_id", "local_idx", "vec_id"])


@dataclass
class _Written(WriterCommitMessage):
    rows: int


class _Writer(DataSourceArrowWriter):
    """Writes rows (at, value) of fixed width to their places in a file that has its header and its full size already. A task
    that runs again writes the same bytes to the same places. The file gets its name when all rows have been counted."""

    def __init__(self, kind: str, options: dict):
        self.kind, self.path = kind, options["path"]
        self.start, self.width, self.rows = (int(options[k]) for k in ("start", "width", "rows"))

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        n = 0
        with open(self.path + ".writing", "r+b") as f:
            for b in batches:
                if not b.num_rows:
                    continue
                at, data = b.column(0).to_numpy(), self._encoded(b.column(1))
                edges = [0, *(np.flatnonzero(np.diff(at) != 1) + 1).tolist(), len(at)]
                for lo, hi in zip(edges, edges[1:], strict=False):
                    f.seek(self.start + int(at[lo]) * self.width)
                    f.write(data[lo:hi].tobytes())
                n += b.num_rows
        return _Written(n)

    def _encoded(self, values: pa.Array) -> np.ndarray:
        if not pa.types.is_list(values.type):
            return values.to_numpy().astype(f"<u{self.width}").reshape(-1, 1)
        flat = values.flatten().to_numpy(zero_copy_only=False)
        if self.kind == "pqcodes":
            return flat.astype(np.uint8).reshape(len(values), self.width)
        dim = self.width // 4 - 1
        if (np.diff(values.offsets.to_numpy()) != dim).any():
            raise ValueError(f"all rows of a file should have {dim} values")
        out = np.empty((len(values), dim + 1), "<i4")
        out[:, 0] = dim
        out[:, 1:] = flat.astype("<f4" if self.kind == "fvecs" else "<i4").reshape(-1, dim).view("<i4")
        return out

    def commit(self, messages: list) -> None:
        done = sum(m.rows for m in messages if m is not None)
        if done != self.rows:
            raise ValueError(f"{done} rows were written, not {self.rows}")

    def abort(self, messages: list) -> None:
        """The unfinished file keeps its other name."""


class _File(DataSource):
    kind = ""

    @classmethod
    def name(cls) -> str:
        return cls.kind

    def schema(self) -> str:
        return KINDS[self.kind][0]

    def reader(self, schema) -> _Reader:
        return _Reader(self.kind, self.options)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.kind, self.options)


class Fvecs(_File):
    kind = "fvecs"


class Ivecs(_File):
    kind = "ivecs"


class U32List(_File):
    kind = "u32list"


class PqCodes(_File):
    kind = "pqcodes"


class Members(_File):
    kind = "vecmembers"


KINDS = {
    "fvecs": ("vec_id long, embedding array<float>", record_ranges),
    "ivecs": ("qid long, gt array<int>", record_ranges),
    "u32list": ("vec_id long, value long", list_ranges),
    "pqcodes": ("vec_id long, codes array<short>", code_ranges),
    "vecmembers": ("cluster_id long, local_idx long, vec_id long", member_ranges),
}


def register(spark: SparkSession) -> None:
    for source in (Fvecs, Ivecs, U32List, PqCodes, Members):
        spark.dataSource.register(source)


def read(spark: SparkSession, kind: str, path: str, expected: int | None = None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The rows of a file, folder or pattern. `expected`: values a record (fvecs, ivecs), entries (u32list), bytes a row
    (pqcodes) or lists (vecmembers). Files are looked at now, so that damage is an error here."""
    KINDS[kind][1](path, expected, split_bytes)
    register(spark)
    reader = spark.read.format(kind).option("split_bytes", str(split_bytes))
    if expected is not None:
        reader = reader.option("expected", str(expected))
    return reader.load(path)


def placed(rows: DataFrame, order: list[str], value: str) -> tuple[DataFrame, int]:
    """(at, value) in an order over the whole table, `at` counting from 0, as a written table, and the number of rows. Rows are
    sorted by ranges; a range's first number comes from the counts before it."""
    ranged = rows.select(*order, value).repartitionByRange(*order).sortWithinPartitions(*order)
    sorted_ = table(ranged.select(F.col(value).alias("value"), F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "sorted")
    counts = {r["part"]: r["n"] for r in sorted_.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one for each range
    before, starts = 0, []
    for part in range(max(counts, default=-1) + 1):
        starts.append(before)
        before += counts.get(part, 0)
    first = F.get(F.array(*[F.lit(s).cast("long") for s in starts]), F.col("part")) if starts else F.lit(0).cast("long")
    out = sorted_.select((first + F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))).alias("at"), "value")
    out.written_to = sorted_.written_to
    return out, before


def _local(path: str) -> str:
    fs, inner = filesystem(path)
    if not isinstance(fs, pafs.LocalFileSystem):
        raise ValueError("these formats are one file each, written by all tasks at once: its folder must be mounted on all executors")
    return inner


def _start(path: str, header: bytes, size: int) -> None:
    with open(path + ".writing", "wb") as f:
        f.write(header)
        f.truncate(size)


def _put(rows: DataFrame, kind: str, path: str, start: int, width: int, n: int) -> None:
    register(rows.sparkSession)
    options = {"start": str(start), "width": str(width), "rows": str(n)}
    rows.write.format(kind).options(**options).mode("append").save(path)


def _finish(path: str) -> None:
    pafs.LocalFileSystem().move(path + ".writing", path)


def write(rows: DataFrame, kind: str, path: str, order: list[str], value: str) -> None:
    """One file of the rows' values in the order of `order`: fvecs, ivecs, u32list or pqcodes. Tasks write to their byte ranges
    in parallel; the file appears under its name when it is whole. An empty table gives a file without records (for
    fvecs and ivecs an empty one)."""
    path = _local(path)
    data, n = placed(rows, order, value)
    one = data.select("value").first()
    length = len(one["value"]) if one is not None and kind != "u32list" else 0
    head = {"u32list": struct.pack("<I", n), "pqcodes": struct.pack("<II", n, length)}.get(kind, b"")
    width = {"u32list": 4, "pqcodes": length}.get(kind, 4 + 4 * length)
    _start(path, head, len(head) + n * width)
    if n:
        _put(data, kind, path, len(head), width, n)
    _finish(path)
    discard(data)


def write_members(lists: DataFrame, path: str, nlist: int) -> None:
    """A file of overlapping lists from (cluster_id, local_idx, vec_id): offsets of all `nlist` lists, then ids in order of lists
    and places. Both regions are written in parallel; an id may occur in several lists, or twice in one."""
    path = _local(path)
    data, n = placed(lists, ["cluster_id", "local_idx", "vec_id"], "vec_id")
    sizes = lists.sparkSession.range(nlist).join(lists.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"))
    stray = lists.filter(F.col("cluster_id").isNull() | (F.col("cluster_id") < 0) | (F.col("cluster_id") >= nlist))
    if not stray.isEmpty():
        raise ValueError(f"cluster ids must lie between 0 and {nlist - 1}")
    ends = sizes.select((F.col("id") + 1).alias("at"), F.sum("n").over(W.orderBy("id")).alias("value"))  # a row for each cluster
    start = 16 + 8 * (nlist + 1)
    _start(path, struct.pack("<QQ", nlist, n), start + 4 * n)
    if nlist:
        _put(ends, "u32list", path, 16, 8, nlist)
    if n:
        _put(data, "u32list", path, start, 4, n)
    _finish(path)
    discard(data)
