"""N-gram Jaccard join: documents whose sets of word shingles overlap by three quarters or more.

Two documents link when 100 * |A and B| >= 75 * |A or B|. Then each shares at least three quarters of its own shingles
with the other, which gives the bounds below; all of them are necessary conditions, so no link is lost.

1. Equal sets are one class. Only classes are compared.
2. Filter: of a class's first shingles in hash order a quarter of the slack or more must occur in another class. Each batch
   sends a shingle once, packed by hash range, however many of its documents hold it.
3. Seeds: remaining classes meet by their smallest shingle under two orders, frequent shingles last, in blocks of bounded
   size that all hold the group's pivot. Links within a block give first components.
4. Search: of the classes of whose shingles three quarters or more occur in other components, those that share one of
   their rarest such shingles meet in inverted lists. Each asks by T-occurrence search (DivideSkip): a heap merges its short
   lists, the long ones are probed by bisection, and classes that reach the required overlap join components.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm import textkit as K
from vecloom.llm.components import components
from vecloom.llm.storage import Scratch, table

WORDS = 5
PERCENT = 75
BUCKET_ENTRIES = 500_000
BLOCK_ROWS = 512
BLOCK_ENTRIES = 1_000_000  # shingles of the sets that ask for their shingles' counts together
BIN_ENTRIES = 500_000  # shingles in the inverted lists of one search
BROADCAST_ROWS = 500_000  # of two to five longs each; above that Spark joins by shuffle
CELL_BITS = 16
WINDOW = 256  # sets that a step of the heap merge counts
_SEED = np.uint64(0x5851F42D4C957F2D)


def least_overlap(n):
    """Of n shingles, those that a linked document shares at least: ceil(0.75 n)."""
    return (3 * n + 3) // 4


def pair_overlap(a, b):
    """Of two sets of a and b shingles that link, the size of the intersection at least: ceil(3/7 (a + b))."""
    return (3 * (a + b) + 6) // 7


def _pack(x: np.ndarray, width: int) -> np.ndarray:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]


def _unpack(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view("<u8").ravel()


def _set_hash(tokens: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit hash per set, whatever its order; never 0."""
    sums = np.zeros(len(tokens) + 1, np.uint64)
    np.cumsum(K.mix(tokens ^ _SEED), out=sums[1:])
    return K.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64) * _SEED) | np.uint64(1)


def _by_bucket(bucket: np.ndarray, rows: np.ndarray, names: list[str]) -> pa.RecordBatch:
    """One row per bucket with its packed rows."""
    order = np.argsort(bucket, kind="stable")
    bucket, raw = bucket[order], np.ascontiguousarray(rows[order]).tobytes()
    new = np.ones(len(bucket), bool)
    new[1:] = bucket[1:] != bucket[:-1]
    first = np.flatnonzero(new)
    last = np.append(first, len(bucket))[1:]
    width = rows.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(bucket[first].astype(np.int64)), pa.array([raw[s * width : e * width] for s, e in zip(first.tolist(), last.tolist(), strict=True)], pa.binary())], names=names)


def _rows_of(group: pa.Table, column: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(group.column(column).to_pylist()), np.uint8).reshape(-1, width)


def classify(docs: DataFrame, n_words: int = WORDS) -> DataFrame:
    """(id, n, f, t, h) of (id, text, t, h): the number of shingles and the hash of the set, null for an empty one."""
    schema = T.StructType([docs.schema["id"], T.StructField("n", T.LongType()), T.StructField("f", T.LongType()), docs.schema["t"], docs.schema["h"]])

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, f = [], []
            for _, _, data, offsets in K.chunks(b.column(1)):
                tokens, bounds = K.shingle_sets(data, offsets, n_words)
                n.append(np.diff(bounds))
                f.append(_set_hash(tokens, bounds))
            n = np.concatenate(n) if n else np.zeros(0, np.int64)
            f = np.concatenate(f) if f else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype(np.int64)), pa.array(f.view(np.int64), mask=n == 0), b.column(2), b.column(3)], names=schema.names)

    return docs.select("id", "text", "t", "h").mapInArrow(run, schema)


def _first(n):
    """(length of the first part in hash order, shared shingles that it needs)."""
    slack = n - least_overlap(n)
    need = 1 + slack // 4
    return slack + need, need


def shared_counts(docs: DataFrame, bucket_bits: int, n_words: int = WORDS) -> DataFrame:
    """(g, shared): for each class, by 48 bits of its hash, at least the number of its first shingles that occur in another
    class. A batch sends each shingle once: with its class if one class of the batch holds it, else as known to be
    shared. Hashes of 40 bits beyond the bucket's may clash, which can only raise a count."""
    width = 11

    @K.lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tokens, owners = [], []
            for _, _, data, offsets in K.chunks(b.column(0)):
                token, bounds = K.shingle_sets(data, offsets, n_words)
                n = np.diff(bounds)
                part, _ = _first(n)
                keep = np.arange(len(token)) - np.repeat(bounds[:-1], n) < np.repeat(part, n)
                tokens.append(token[keep])
                owners.append(np.repeat(_set_hash(token, bounds), n)[keep])
            if not tokens:
                continue
            token, owner = np.concatenate(tokens), np.concatenate(owners) & np.uint64((1 << 48) - 1)
            order = np.lexsort((owner, token))
            token, owner = token[order], owner[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
            token, owner = token[new], owner[new]
            if not len(token):
                continue
            first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(first, len(token)))
            here, n = np.unique(owner[np.repeat(size > 1, size)], return_counts=True)
            token, owner = token[first], np.where(size > 1, np.uint64(0), owner[first])
            bucket = (token >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(token), np.int64)
            rest = (token << np.uint64(bucket_bits)) >> np.uint64(24)
            yield _by_bucket(bucket, np.hstack([_pack(rest, 5), _pack(owner, 6)]), ["bucket", "packed"])
            yield _by_bucket(np.full(len(here), -1 - (int(here[0]) % 4096 if len(here) else 0)), np.hstack([_pack(here, 6), _pack(n, 5)]), ["bucket", "packed"])

    def reply(g: np.ndarray, n: np.ndarray) -> pa.Table:
        bucket = (g >> np.uint64(48 - bucket_bits)).astype(np.int64)
        return pa.Table.from_batches([_by_bucket(bucket, np.hstack([_pack(g, 6), _pack(n, 5)]), ["range", "counts"])])

    def count(key: tuple, group: pa.Table) -> pa.Table:
        rows = _rows_of(group, "packed", width)
        if key[0].as_py() < 0:
            return reply(_unpack(rows[:, :6]), _unpack(rows[:, 6:]))
        token, owner = _unpack(rows[:, :5]), _unpack(rows[:, 5:])
        order = np.lexsort((owner, token))
        token, owner = token[order], owner[order]
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])
        token, owner = token[new], owner[new]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        size = np.diff(np.append(first, len(token)))
        K.release()
        known = np.repeat((size > 1) | (owner[first] == 0), size) & (owner != 0)
        return reply(*np.unique(owner[known], return_counts=True))

    def add(key: tuple, group: pa.Table) -> pa.Table:
        rows = _rows_of(group, "counts", width)
        g, place = np.unique(_unpack(rows[:, :6]), return_inverse=True)
        total = np.bincount(place, _unpack(rows[:, 6:]).astype(np.int64), len(g)).astype(np.int64)
        return pa.table({"g": pa.array(g.view(np.int64)), "shared": pa.array(total)})

    packed = docs.select("text").mapInArrow(send, "bucket long, packed binary")
    counted = packed.groupBy("bucket").applyInArrow(count, "range long, counts binary")
    return counted.groupBy("range").applyInArrow(add, "g long, shared long")


def _hint(df: DataFrame) -> DataFrame:
    """`df`, a written table, marked for broadcast only if its counted rows are few."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def set_table(docs: DataFrame, wanted: DataFrame, n_words: int = WORDS) -> DataFrame:
    """(f, n, tokens): the sorted shingles of the wanted classes."""
    schema = T.StructType([T.StructField("f", T.LongType()), T.StructField("n", T.LongType()), T.StructField("tokens", T.BinaryType())])

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, offsets in K.chunks(b.column(0)):
                token, bounds = K.shingle_sets(data, offsets, n_words)
                raw = token.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(_set_hash(token, bounds).view(np.int64)), pa.array(np.diff(bounds).astype(np.int64)), pa.array([raw[8 * s : 8 * e] for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary())], names=schema.names)

    rows = docs.join(_hint(wanted), (docs["t"] == wanted["wt"]) & docs["id"].eqNullSafe(wanted["wid"])).select("text")
    return rows.mapInArrow(run, schema)


def key_table(sets: DataFrame, heavy: np.ndarray) -> DataFrame:
    """(f, k0, k1): each class's smallest shingle under two orders, frequent shingles last."""

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k0, k1 = [], []
            for raw in b.column(1):
                token = np.frombuffer(raw.as_buffer(), np.uint64)
                light = token[~heavy[(token & np.uint64((1 << CELL_BITS) - 1)).astype(np.int64)]]
                token = light if len(light) else token
                k0.append(token[0])
                k1.append(K.mix(token + _SEED).min())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(k0, np.uint64).view(np.int64)), pa.array(np.array(k1, np.uint64).view(np.int64))], names=["f", "k0", "k1"])

    return sets.select("f", "tokens").mapInArrow(run, "f long, k0 long, k1 long")


class Postings:
    """Inverted lists of some sets, numbered as given."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        flat = np.concatenate(sets)
        number = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(flat, kind="stable")
        self.token, start = np.unique(flat[order], return_index=True)
        self.members = number[order]
        self.bounds = np.append(start, len(flat))
        self.lengths = np.array([len(s) for s in sets])

    def hopeful(self, query: int) -> bool:
        """Whether enough shingles of set `query` occur in other sets, too."""
        at = np.searchsorted(self.token, self.sets[query])
        return int((self.bounds[at + 1] - self.bounds[at] > 1).sum()) >= least_overlap(len(at))

    def linked(self, query: int) -> list[int]:
        """Sets that link with set `query`, by DivideSkip: sets that occur often enough in the short lists come out of a
        heap over them, and are looked up in the long ones by bisection."""
        mine = self.sets[query]
        at = np.searchsorted(self.token, mine)
        at = at[np.argsort(self.bounds[at + 1] - self.bounds[at], kind="stable")]
        lists = [self.members[self.bounds[i] : self.bounds[i + 1]] for i in at]
        need = least_overlap(len(mine))
        n_long = min(need - 1, int(need / (0.01 * np.log2(max(2, len(lists[-1]))) + 1)))
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        other, count = merge_skip([m for m in short if len(m) > 1], need - n_long, query)
        a, b = len(mine), self.lengths[other]
        overlap = pair_overlap(a, b)
        for left, members in zip(range(len(long), 0, -1), reversed(long), strict=True):
            keep = count + left >= overlap
            if not keep.all():
                other, count, overlap, b = other[keep], count[keep], overlap[keep], b[keep]
            if not len(other):
                return []
            i = np.minimum(np.searchsorted(members, other), len(members) - 1)
            count = count + (members[i] == other)
        return other[(count >= overlap) & (100 * count >= PERCENT * (a + b - count))].tolist()


def merge_skip(lists: list[np.ndarray], need: int, query: int) -> tuple[np.ndarray, np.ndarray]:
    """(set, lists it is in) for the sets other than `query` in at least `need` of the sorted lists.

    A heap holds the lists by their next entry. All lists with an entry in the next WINDOW numbers leave it and are counted
    together. If they are too few, further ones leave it, and all that left skip to the entry at its top: a set before
    that one is in too few lists.
    """
    found, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    heap = [(int(m[0]), k, 0) for k, m in enumerate(lists)]
    heapq.heapify(heap)
    while len(heap) >= need and heap:
        low = heap[0][0]
        target, popped = low + WINDOW, []
        while heap and heap[0][0] < target:
            popped.append(heapq.heappop(heap))
        if len(popped) >= need:
            ends = [i + int(lists[k][i:].searchsorted(target)) for _, k, i in popped]
            n = np.bincount(np.concatenate([lists[k][i:e] for (_, k, i), e in zip(popped, ends, strict=True)]) - low, minlength=WINDOW)
            some = np.flatnonzero(n >= need)
            found.append(some + low)
            counts.append(n[some])
        else:
            while heap and len(popped) < need - 1:
                popped.append(heapq.heappop(heap))
            if not heap:
                break
            target = max(target, heap[0][0])
            ends = [i + int(lists[k][i:].searchsorted(target)) for _, k, i in popped]
        for (_, k, _), e in zip(popped, ends, strict=True):
            if e < len(lists[k]):
                heapq.heappush(heap, (int(lists[k][e]), k, e))
    other, count = np.concatenate(found), np.concatenate(counts)
    return other[other != query], count[other != query]


class Union:
    """Labels that links join."""

    def __init__(self, labels):
        self.up = {p: p for p in labels}

    def find(self, p: int) -> int:
        while self.up[p] != p:
            self.up[p] = self.up[self.up[p]]
            p = self.up[p]
        return p

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.find(a), self.find(b)
        self.up[a] = b
        return a != b


def _seed_links(group: pd.DataFrame) -> pd.DataFrame:
    """Links within one block that join its classes: to the pivot where it links, else by search. No more leave than
    classes came."""
    group = group.drop_duplicates("f")
    group = group.assign(n=group["tokens"].map(len)).sort_values(["n", "f"])
    sets = [np.frombuffer(t, np.uint64) for t in group["tokens"]]
    f, pivot = group["f"].to_numpy(), int(np.flatnonzero(group["f"].to_numpy() == group["pivot"].to_numpy())[0])
    base, links, rest, known = sets[pivot], [], [], Union(range(len(sets)))
    for i, s in enumerate(sets):
        if i == pivot:
            continue
        place = np.minimum(np.searchsorted(base, s), len(base) - 1)
        both = int((base[place] == s).sum())
        if 100 * both >= PERCENT * (len(s) + len(base) - both):
            links.append((f[i], f[pivot]))
            known.join(i, pivot)
        else:
            rest.append(i)
    if rest:
        postings = Postings(sets)
        for i in filter(postings.hopeful, rest):
            links += [(f[i], f[j]) for j in postings.linked(i) if known.join(i, j)]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def seed_links(sets: DataFrame, keys: DataFrame, key: str, block_rows: int, scratch: Scratch) -> DataFrame:
    """(a, b): links among classes with one key of (f, key). Groups over `block_rows` are dealt out into blocks."""
    groups = keys.groupBy(key).agg(F.count("*").alias("rows"), F.min("f").alias("pivot")).filter("rows > 1").withColumn("blocks", F.ceil(F.col("rows") / block_rows))
    members = scratch.table(keys.join(groups, key).select(F.col("f").alias("mf"), F.col(key).alias("key"), "pivot", "blocks"), "members")
    rows = sets.select("f", "tokens").join(_hint(members), sets["f"] == members["mf"])
    own = F.pmod(F.xxhash64("f"), F.col("blocks"))
    blocks = F.when(F.col("f") == F.col("pivot"), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array(own))
    dealt = rows.withColumn("block", F.explode(blocks)).select("key", "block", "f", "pivot", "tokens")
    return dealt.groupBy("key", "block").applyInPandas(_seed_links, "a long, b long")


def _heavy(sets: DataFrame) -> np.ndarray:
    """Which of 2^16 hash cells hold frequent shingles, for the order of the seeds' keys. It is the same size for any input."""
    cells = 1 << CELL_BITS

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        for b in batches:
            for raw in b.column(0):
                counts += np.bincount((np.frombuffer(raw.as_buffer(), np.uint64) & np.uint64(cells - 1)).astype(np.int64), minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cells)), pa.array(counts)], names=["cell", "n"])

    out = np.zeros(cells)
    for cell, n in sets.select("tokens").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[cell] = n
    mean = out.mean()
    return out > mean + 6 * np.sqrt(mean) + 2


def blocks_of(sets: DataFrame, part: DataFrame, block_entries: int) -> DataFrame:
    """(block, f, c, n, tokens): the sets and their components in blocks of about `block_entries` shingles, one row each."""
    names = ["block", "f", "c", "n", "tokens"]

    @K.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[int, int, bytes]] = []
        held = 0

        def flush() -> pa.RecordBatch:
            f, c, raw = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([f[0]], pa.int64()), pa.array([f], pa.list_(pa.int64())), pa.array([c], pa.list_(pa.int64())), pa.array([[len(t) // 8 for t in raw]], pa.list_(pa.int64())), pa.array([b"".join(raw)], pa.binary())], names=names)

        for b in batches:
            for row in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                rows.append(row)
                held += len(row[2]) // 8
                if held >= block_entries:
                    yield flush()
                    rows, held = [], 0
        if rows:
            yield flush()

    known = sets.join(_hint(part), sets["f"] == part["node"], "left").select("f", F.coalesce("component", "f").alias("c"), "tokens")
    return known.mapInArrow(run, "block long, f array<long>, c array<long>, n array<long>, tokens binary")


def prefixes(blocks: DataFrame, bucket_bits: int) -> DataFrame:
    """(token, f, c, n): for classes of whose n shingles enough occur in other components, the rarest of those shingles, one
    more than a link can do without. Classes that link across components share one of them.

    A block sends each shingle once, with its number of classes, and their component or 0 where there are several; so
    a shingle that very many classes hold is a row per block. What comes back to a block are the shingles that several
    components hold, with the number of their classes, by which they are ordered.
    """

    @K.lean
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, c, n, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                token, part = np.frombuffer(raw.as_buffer(), np.uint64), np.repeat(np.array(c, np.int64), n)
                order = np.argsort(token, kind="stable")
                token, part = token[order], part[order]
                first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
                size = np.diff(np.append(first, len(token)))
                low = np.minimum.reduceat(part, first)
                part = np.where(low == np.maximum.reduceat(part, first), low, 0)
                bucket = (token[first] >> np.uint64(64 - bucket_bits)).astype(np.int64) if bucket_bits else np.zeros(len(first), np.int64)
                out = _by_bucket(bucket, np.hstack([_pack(token[first], 8), _pack(size, 3), _pack(part.view(np.uint64), 8)]), ["bucket", "packed"])
                yield pa.RecordBatch.from_arrays([out.column(0), pa.array(np.full(len(out), block)), out.column(1)], names=["bucket", "block", "packed"])

    def mixed(group: pa.Table) -> pa.Table:
        blocks, raw = group.column("block").to_numpy(), group.column("packed").to_pylist()
        rows = np.frombuffer(b"".join(raw), np.uint8).reshape(-1, 19)
        at = np.repeat(np.arange(len(raw)), [len(r) // 19 for r in raw])
        token, size, part = _unpack(rows[:, :8]), _unpack(rows[:, 8:11]).astype(np.int64), _unpack(rows[:, 11:]).view(np.int64)
        order = np.argsort(token, kind="stable")
        token, size, part, at = token[order], size[order], part[order], at[order]
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        many = (np.minimum.reduceat(part, first) != np.maximum.reduceat(part, first)) | (np.minimum.reduceat(np.abs(part), first) == 0)
        width = np.diff(np.append(first, len(token)))
        keep = np.repeat(many, width)
        total = np.repeat(np.add.reduceat(size, first), width)[keep]
        out = _by_bucket(at[keep], np.hstack([_pack(token[keep], 8), _pack(total, 6)]), ["at", "packed"])
        K.release()
        return pa.table({"block": pa.array(blocks[out.column(0).to_numpy()]), "packed": out.column(1)})

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = _rows_of(right, "packed", 14)
        token, total = _unpack(rows[:, :8]), _unpack(rows[:, 8:]).astype(np.int64)
        order = np.argsort(token)
        token, total = token[order], total[order]
        out = []
        for f, c, n, raw in zip(*(left.column(k).to_pylist() for k in ("f", "c", "n", "tokens")), strict=True):
            n = np.array(n, np.int64)
            mine, owner = np.frombuffer(raw, np.uint64), np.repeat(np.arange(len(n)), n)
            at = np.minimum(np.searchsorted(token, mine), max(0, len(token) - 1))
            held = token[at] == mine if len(token) else np.zeros(len(mine), bool)
            shared = np.bincount(owner[held], minlength=len(n))
            spare = np.where(shared >= least_overlap(n), shared - least_overlap(n) + 1, 0)
            held &= spare[owner] > 0
            mine, owner, often = mine[held], owner[held], total[at[held]]
            order = np.lexsort((mine, often, owner))
            mine, owner = mine[order], owner[order]
            place = np.arange(len(owner)) - np.searchsorted(owner, owner)
            keep = place < spare[owner]
            out.append((mine[keep].view(np.int64), np.array(f, np.int64)[owner[keep]], np.array(c, np.int64)[owner[keep]], n[owner[keep]]))
        return pa.table(dict(zip(("token", "f", "c", "n"), (pa.array(np.concatenate(x)) for x in zip(*out, strict=True)), strict=True)) if out else {k: pa.array([], pa.int64()) for k in ("token", "f", "c", "n")})

    sent = blocks.select("block", "c", "n", "tokens").mapInArrow(send, "bucket long, block long, packed binary")
    back = sent.groupBy("bucket").applyInArrow(mixed, "block long, packed binary")
    return blocks.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(choose, "token long, f long, c long, n long")


def _search(group: pd.DataFrame) -> pd.DataFrame:
    """Links that join components, as pairs of components, from the searches of this group's query classes among all its
    classes. A link between two components is enough, so no more leave than classes came."""
    group = group.assign(n=group["tokens"].map(len)).sort_values(["n", "f"])
    part, asks = group["c"].to_numpy(), group["asks"].to_numpy()
    postings = Postings([np.frombuffer(t, np.uint64) for t in group["tokens"]])
    known, links = Union(set(part.tolist())), []
    for q in np.flatnonzero(asks).tolist():
        if postings.hopeful(q):
            links += [(part[q], part[o]) for o in postings.linked(q) if known.join(part[q], part[o])]
    return pd.DataFrame(links, columns=["a", "b"], dtype="int64")


def cross_links(sets: DataFrame, part: DataFrame, block_entries: int, bin_entries: int, scratch: Scratch) -> DataFrame:
    """(a, b): components that links between classes join, by T-occurrence search.

    Classes that share a shingle of their prefixes make groups. Small groups are packed into bins, each with inverted lists
    of its own. A larger group is dealt out into blocks: those of classes outside its most frequent component ask
    all blocks. Links within the most frequent component add nothing, and others are found from their other end.
    """
    total = sets.agg(F.sum("n").alias("s")).first()["s"] or 0
    blocks = scratch.table(blocks_of(sets, part, block_entries), "blocks")
    rows = scratch.table(prefixes(blocks, max(0, int(np.ceil(np.log2(max(1.0, total / block_entries)))))), "prefixes")
    lists = scratch.table(rows.groupBy("token").agg(F.min("f").alias("hub"), F.min("c").alias("low"), F.max("c").alias("high")).filter("low != high").select("token", "hub"), "lists")
    groups = components(rows.join(lists, "token").select(F.col("f").alias("a"), F.col("hub").alias("b")))
    live = scratch.table(rows.select("f", "c", "n").distinct().join(groups, F.col("f") == F.col("node")).select("f", "c", "n", F.col("component").alias("grp")), "live")
    parts = live.groupBy("grp", "c").agg(F.count("*").alias("rows"), F.sum("n").alias("entries"))
    sizes = parts.groupBy("grp").agg(F.max(F.struct("rows", "c")).alias("main"), F.sum("entries").alias("entries"), F.max(F.struct("rows", "c", "entries"))["entries"].alias("main_entries"))
    half = F.lit(max(1, bin_entries // 2))
    sizes = sizes.withColumn("asking", F.ceil((F.col("entries") - F.col("main_entries")) / half)).withColumn("asked", F.ceil(F.col("main_entries") / half)).withColumn("small", F.col("entries") <= bin_entries)
    bins = max(1, -(-int(live.agg(F.sum("n").alias("s")).first()["s"] or 0) // bin_entries))
    sizes = scratch.table(sizes.select(F.col("grp").alias("g"), F.col("main.c").alias("main"), "asking", "asked", "small"), "groups")
    placed = live.join(sizes, live["grp"] == sizes["g"]).withColumn("asks", F.col("c") != F.col("main"))
    hashed = F.xxhash64("f")
    place = F.when(F.col("small"), F.lit(0).cast("long")).when(F.col("asks"), F.pmod(hashed, "asking")).otherwise(F.col("asking") + F.pmod(hashed, "asked"))
    meets = F.when(F.col("small"), F.lit(1).cast("long")).when(F.col("asks"), F.col("asking") + F.col("asked")).otherwise(F.col("asking"))
    key = F.when(F.col("small"), F.pmod(F.xxhash64("grp"), F.lit(bins))).otherwise(F.col("grp"))
    placed = scratch.table(placed.select(F.col("f").alias("pf"), "c", "asks", "small", key.alias("key"), place.alias("own"), meets.alias("meets")), "placed")
    dealt = sets.select("f", "tokens").join(_hint(placed), sets["f"] == placed["pf"]).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("meets") - 1)))
    dealt = dealt.select("small", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "f", "c", "asks", "tokens")
    return dealt.groupBy("small", "key", "i", "j").applyInPandas(_search, "a long, b long")


def _labels(rows: DataFrame, n_words: int, bucket_entries: int, block_rows: int, block_entries: int, bin_entries: int) -> tuple[DataFrame, DataFrame]:
    """(known, labels) of (id, text, t, h): known has (id, n, f, t, h), labels has (lf, label), one row per class f, equal
    for classes that links join."""
    scratch = Scratch()
    known = table(classify(rows, n_words), "sets")
    classes = scratch.table(known.filter("f is not null").groupBy("f").agg(F.min("n").alias("n"), F.min(F.struct("t", "id")).alias("r")), "classes")
    total = classes.agg(F.sum("n").alias("s")).first()["s"] or 0
    bits = max(0, int(np.ceil(np.log2(max(1.0, total / 3 / bucket_entries)))))
    shared = shared_counts(rows, bits, n_words)
    slack = F.col("n") - F.expr("(3 * n + 3) div 4")
    need = 1 + F.floor(slack / 4)
    wanted = classes.withColumn("g", F.col("f").bitwiseAND(F.lit((1 << 48) - 1))).join(shared, "g").filter(F.col("shared") >= need)
    wanted = scratch.table(wanted.select(F.col("f").alias("wf"), F.col("r.t").alias("wt"), F.col("r.id").alias("wid")), "wanted")
    sets = scratch.table(set_table(rows, wanted, n_words).filter("n > 0"), "tokens")
    if sets.count() > wanted.count():  # rows that are alike in id and text
        sets = scratch.table(sets.dropDuplicates(["f"]), "tokens")
    keys = scratch.table(key_table(sets, _heavy(sets)), "keys")
    seeds = scratch.table(seed_links(sets, keys, "k0", block_rows, scratch).unionByName(seed_links(sets, keys, "k1", block_rows, scratch)).distinct(), "seeds")
    part = scratch.table(components(seeds), "part")
    more = scratch.table(components(cross_links(sets, part, block_entries, bin_entries, scratch)).select(F.col("node").alias("mn"), F.col("component").alias("mc")), "more")
    one = classes.select("f").join(part, classes["f"] == part["node"], "left").select("f", F.coalesce("component", "f").alias("c"))
    labels = one.join(more, one["c"] == more["mn"], "left").select(F.col("f").alias("lf"), F.coalesce("mc", "c").alias("label"))
    labels = table(labels, "labels")
    scratch.clear()
    return known, labels


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = WORDS, bucket_entries: int = BUCKET_ENTRIES, block_rows: int = BLOCK_ROWS, block_entries: int = BLOCK_ENTRIES, bin_entries: int = BIN_ENTRIES) -> DataFrame:
    """One row per input row: the id, n_shingles (of its set), component_id (the smallest id reachable by links).

    A text of fewer than `n_words` words has its whole sequence as its one shingle. A null text or one without words has
    none and links with nothing; its component is its own id. Rows with equal sets link, repeated rows and rows with one id
    included. A null id stays null, and names a component only if all its ids are null. Very long texts are read
    whole; other columns are not read; an empty table gives no rows.

    Shuffled are, packed: a third of the shingles once; of classes that pass the filter, the sets twice and their shingles
    once; and the sets of classes left for the search. Components never reach the driver.
    """
    t = F.xxhash64(text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), t.alias("t"), t.alias("h"))
    known, labels = _labels(rows, n_words, bucket_entries, block_rows, block_entries, bin_entries)
    least = known.filter("f is not null").groupBy("f").agg(F.min("id").alias("least"))
    labeled = least.join(labels, least["f"] == labels["lf"])
    smallest = labeled.groupBy("label").agg(F.min("least").alias("component_id"))
    result = table(labeled.join(smallest, "label").select(F.col("f").alias("rf"), "component_id"), "result")
    joined = known.join(result, known["f"] == result["rf"], "left")
    return joined.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("f").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each group of linked rows of `docs` the one with the smallest id, all columns as they are.

    Of rows with that id the one of smallest hash over all columns stays, and of rows alike in all columns one. A null id is
    larger than all others. Rows without words, null texts included, link with nothing and all stay. Other columns
    may have any name. An empty table gives no rows.
    """
    row_hash = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("t"), row_hash.alias("h"))
    known, labels = _labels(rows, WORDS, BUCKET_ENTRIES, BLOCK_ROWS, BLOCK_ENTRIES, BIN_ENTRIES)
    grouped = known.filter("f is not null").groupBy("f", "h").agg(F.min(F.struct(F.col("id").isNull(), "id")).alias("i"), F.count("*").alias("n"))
    labeled = table(grouped.join(labels, grouped["f"] == labels["lf"]).select("label", "i", "h", "n"), "labeled")
    best = labeled.groupBy("label").agg(F.min(F.struct("i", "h")).alias("best"))
    judged = table(labeled.join(best, "label").select("h", "n", (F.col("best.h") == F.col("h")).alias("stays")).distinct(), "judged")
    tagged = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row_hash.alias("h"))
    drop, twins = judged.filter("not stays").select("h"), judged.filter("stays and n > 1").select("h")
    kept = tagged.join(_hint(drop), "h", "left_anti")
    if not twins.isEmpty():  # rows alike in every column: one of them stands for all
        kept = kept.join(_hint(twins), "h", "left_anti").unionByName(tagged.join(_hint(twins), "h", "left_semi").dropDuplicates(["h"]))
    return kept.select("row.*")
