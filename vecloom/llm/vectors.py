"""Embedding near-duplicates by a forest of random-projection trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecloom.llm.components import components
from vecloom.llm import textkit as K
from vecloom.llm.storage import table

COSINE = 0.95
TREES = 2  # over the table: their splits are fitted on a sample, and rows are sent to their leaves
TOP_ROWS = 12_000  # in a leaf of these at most, about
FEW = 64  # of the sample, that a median is taken of
TRIES = 4  # directions of a level
MOST_LEVELS = 48
FIT_ROWS = 50_000  # bound of the sample that the splits are fitted on; all rows are indexed
GROUP_ROWS = 20_000  # in such a leaf, up to which a task splits it further by trees of its own
LEAF_TREES = 4
LEAF_ROWS = 512
BLOCK_ROWS = 2048  # compared at a time
SPILL = 0.5
SEED = 7


class Tree:
    """Random splits at the median of a projection. Vectors within the margin of a split go both ways.

    Each level of the tree has TRIES random directions, of which a node takes the first that splits its vectors; so all
    projections of a batch are one product, and it goes down level by level. A node knows its rows by the share of its sample
    that went each way. Where fewer than FEW of the sample are left, the sample of the nearest node above with more stands
    for it: along a further random direction the halves of a node lie much like the node itself. So leaves keep their size
    however many rows a bounded sample stands for.
    """

    def __init__(self, sample: np.ndarray, rows: float, margin: float, seed: list[int], most: int, least: int = 1):
        self.margin, self.seed, self.size = margin, seed, sample.shape[1]
        self.column: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaves, levels = 0, 0
        if rows > most and len(sample) >= least:
            p = sample @ self._directions(MOST_LEVELS)
            known: dict[tuple[int, int], tuple | None] = {}  # splits by (stand-in, level)
            todo = [(0, None, np.arange(len(sample)), (0, np.arange(len(sample))), float(rows))]  # level, link to set, sample, its stand-in, rows
            while todo:
                level, link, own, stand, n = todo.pop()
                node, found = len(self.cut), None
                if n > most and len(own) >= least and level < MOST_LEVELS:
                    stand = (node, own) if len(own) >= FEW else stand
                    if (stand[0], level) not in known:
                        known[stand[0], level] = self._split(p[stand[1]], level)
                    found = known[stand[0], level]
                if link is not None:
                    link[0][link[1]] = node if found else -self._leaf()
                if not found:
                    self.leaves += link is None
                    continue
                column, cut, *shares = found
                self.column.append(column)
                self.cut.append(cut)
                self.left.append(0)
                self.right.append(0)
                at = p[own, column]
                todo.append((level + 1, (self.right, node), own[at >= cut - self.margin], stand, n * shares[1]))
                todo.append((level + 1, (self.left, node), own[at <= cut + self.margin], stand, n * shares[0]))
        else:
            self._leaf()
        self.levels = max((c // TRIES for c in self.column), default=-1) + 1
        self.column, self.left, self.right = (np.array(v, np.int64) for v in (self.column, self.left, self.right))
        self.cut = np.array(self.cut)

    def _directions(self, levels: int) -> np.ndarray:
        d = np.stack([np.random.default_rng([*self.seed, k]).standard_normal(self.size) for k in range(levels * TRIES)], 1) if levels else np.zeros((self.size, 0))
        return d / np.maximum(np.linalg.norm(d, axis=0), 1e-300)

    def _leaf(self) -> int:
        self.leaves += 1
        return self.leaves

    def _split(self, p: np.ndarray, level: int) -> tuple[int, float, float, float] | None:
        """(column, cut, share that goes left, share that goes right) of the first direction along which copies lie apart."""
        for column in range(level * TRIES, (level + 1) * TRIES):
            cut = float(np.median(p[:, column]))
            shares = float((p[:, column] <= cut + self.margin).mean()), float((p[:, column] >= cut - self.margin).mean())
            if max(shares) <= 0.8:
                return column, cut, *shares
        return None

    def leaves_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for every leaf that a row reaches; leaves are numbered from 0."""
        row = np.arange(len(x))
        if not len(self.cut):
            return row, np.zeros(len(x), np.int64)
        p, node, rows, leaves = x @ self._directions(self.levels), np.zeros(len(x), np.int64), [], []
        while len(row):
            at, cut = p[row, self.column[node]], self.cut[node]
            left, right = at <= cut + self.margin, at >= cut - self.margin
            row, node = np.concatenate([row[left], row[right]]), np.concatenate([self.left[node[left]], self.right[node[right]]])
            done = node < 0
            rows.append(row[done])
            leaves.append(-node[done] - 1)
            row, node = row[~done], node[~done]
        return np.concatenate(rows), np.concatenate(leaves)


def margin_of(cosine: float, size: int) -> float:
    """Spill of a split: of the order of the distance, along a random direction, of two vectors at `cosine`."""
    return SPILL * np.sqrt(2 - 2 * cosine) / np.sqrt(size)


class Forest:
    """Trees for each length of vectors. Lengths that the sample lacks have one leaf each."""

    def __init__(self, sample: list[np.ndarray], total: int, trees: int, cosine: float):
        self.trees: dict[int, list[tuple[int, Tree]]] = {}
        self.leaves = 0
        for size in sorted({len(v) for v in sample}):
            x = unit(np.array([v for v in sample if len(v) == size], np.float64))
            self.trees[size] = []
            for t in range(trees):
                tree = Tree(x, total * len(x) / len(sample), margin_of(cosine, size), [SEED, size, t], TOP_ROWS)
                self.trees[size].append((self.leaves, tree))
                self.leaves += tree.leaves

    def leaves_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf), sorted by row and leaf; a leaf's number tells its tree, too."""
        trees = self.trees.get(x.shape[1])
        if trees is None:
            return np.arange(len(x)), np.full(len(x), self.leaves + x.shape[1])
        found = [(r, leaf + base) for base, tree in trees for r, leaf in [tree.leaves_of(x)]]
        row, leaf = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        order = np.lexsort((leaf, row))
        return row[order], leaf[order]


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(np.float64).tiny)  # no overflow in the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Whether a vector is not null, has no null or non-finite component, and is not zero."""
    x = F.transform(vector, lambda v: v.cast("double"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0.0), F.lit(False))


def _vectors(b: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of vectors in a batch."""
    lists = b.column(column)
    at = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    for n in np.unique(size):
        rows = np.flatnonzero(size == n)
        yield rows, flat[at[rows][:, None] + np.arange(n)]


def _merge(mask: np.ndarray) -> np.ndarray:
    """Smallest row reachable from each row, for a symmetric mask of links."""
    label = np.arange(len(mask))
    while True:
        new = np.minimum(label, np.where(mask, label[None, :], len(mask)).min(axis=1, initial=len(mask)))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _links_within(x: np.ndarray, ids: np.ndarray, n: np.ndarray, earlier: list[np.ndarray], apart: np.ndarray | None, cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, links, root) for the rows of x that link with others: the number of linked rows that share no earlier leaf,
    and the smallest class reached. All pairs are compared; those of equal `apart` are left out."""
    mask = x @ x.T >= cosine
    np.fill_diagonal(mask, False)
    if apart is not None:
        mask &= apart[:, None] != apart[None, :]
    some = np.flatnonzero(mask.any(axis=1))
    mask, ids, n, earlier = mask[np.ix_(some, some)], ids[some], n[some], [earlier[i] for i in some.tolist()]
    known, place = np.unique(np.concatenate(earlier) if earlier else np.zeros(0), return_inverse=True)
    fresh = mask
    if len(known):
        one = np.zeros((len(some), len(known)), np.float32)
        one[np.repeat(np.arange(len(some)), [len(e) for e in earlier]), place] = 1
        fresh = mask & (one @ one.T == 0)
    root = _merge(mask)
    least = np.full(len(some), np.iinfo(np.int64).max)
    np.minimum.at(least, root, ids)
    return ids, fresh @ n.astype(np.int64), least[root]


def _compare(group: pd.DataFrame, cosine: float, block_rows: int) -> pd.DataFrame:
    """Links within a leaf, or between two blocks of it: per row the linked rows that no earlier leaf holds together with
    it, and the smallest class it reaches here. Pairs stay in this function. A leaf of more rows than are compared at a time
    is split further, by LEAF_TREES trees of its own; where that does not split it, it is compared block by block."""
    leaf = int(group["leaf"].iloc[0])
    x = unit(np.stack(group["v"].to_numpy()))
    ids, n = group["c"].to_numpy(), group["n"].to_numpy()
    earlier = [np.asarray(v)[np.asarray(v) < leaf] for v in group["leaves"].to_numpy()]
    out = []
    if group["i"].iloc[0] != group["j"].iloc[0]:  # pairs within one block have their own group
        out.append(_links_within(x, ids, n, earlier, group["b"].to_numpy(), cosine))
    elif len(x) <= block_rows:
        out.append(_links_within(x, ids, n, earlier, None, cosine))
    else:
        mine: list[list[int]] = [[] for _ in range(len(x))]  # leaves of this task's trees, below all others
        number = -1
        for t in range(LEAF_TREES):
            tree = Tree(x, len(x), margin_of(cosine, x.shape[1]), [SEED, leaf, 1000 + t], LEAF_ROWS, LEAF_ROWS)
            row, sub = tree.leaves_of(x)
            order = np.argsort(sub, kind="stable")
            for at in np.split(row[order], np.flatnonzero(np.diff(sub[order])) + 1):
                blocks = [at[k : k + block_rows] for k in range(0, len(at), block_rows)]
                for p, a in enumerate(blocks):
                    for b in blocks[p:]:
                        both = np.unique(np.concatenate([a, b]))
                        apart = None if b is a else np.isin(both, a)
                        out.append(_links_within(x[both], ids[both], n[both], [np.append(earlier[i], mine[i]) for i in both.tolist()], apart, cosine))
                for i in at.tolist():
                    mine[i].append(number)
                number -= 1
    return pd.DataFrame(dict(zip(("c", "links", "root"), map(np.concatenate, zip(*out, strict=True)), strict=True)))


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, trees: int = TREES, block_rows: int = BLOCK_ROWS, fit_rows: int = FIT_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """One row per input row: the id, n_links (other rows at `cosine` or above that the forest finds), component_id (the
    smallest id reachable) and kept (the id is its component's).

    Equal vectors are one class before anything else, counted map-side, so copies cost nothing. Splits are fitted on
    the `fit_rows` classes of lowest hash; every class is indexed. Within a leaf all pairs are verified in double
    precision; a pair that shares several leaves counts in the first only. A leaf of over `block_rows` is split further by
    its task, so leaves keep their size as the table grows; one of over `group_rows` is compared block by block, none is
    cut short. No pairs leave a task: only a count and a link to a local root per row.

    Vectors that are null, empty or zero, or hold null or non-finite components, have no links and are kept. Repeated
    rows link to each other. Null ids have links, but are no component's id unless all of it is null; an empty table
    gives no rows.
    """
    kind = "float" if vectors.schema[vector_col].dataType.elementType == T.FloatType() else "double"  # as narrow as is exact
    rows = vectors.select(F.col(id_col).alias("id"), F.when(usable(F.col(vector_col)), F.transform(vector_col, lambda v: v.cast(kind))).alias("v")).withColumn("c", F.when(F.col("v").isNotNull(), F.xxhash64("v")))
    classes = table(rows.filter("v is not null").groupBy("c", "v").agg(F.count("*").alias("n"), F.min("id").alias("least")), "classes")
    total = classes.count()
    picked = classes.orderBy(F.xxhash64(F.col("c") + SEED), "c").limit(fit_rows).select("v").toArrow().column("v")
    sample = [row for part in picked.chunks for row in np.split(part.flatten().to_numpy(zero_copy_only=False), np.cumsum(part.value_lengths().to_numpy())[:-1])] if total else []
    shared = vectors.sparkSession.sparkContext.broadcast(Forest(sample, total, trees, cosine))  # a few numbers a split; at most about a split for 8 rows of the sample

    @K.lean
    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, forest = {}, shared.value
        for b in batches:
            for _, x in _vectors(b, 0):
                for leaf, n in zip(*np.unique(forest.leaves_of(unit(x))[1], return_counts=True), strict=True):
                    counts[int(leaf)] = counts.get(int(leaf), 0) + int(n)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["leaf", "n"])

    # One row per leaf, of which the bounded sample allows only so many.
    sizes = {r["leaf"]: r["n"] for r in classes.select("v").mapInArrow(leaves, "leaf long, n long").groupBy("leaf").agg(F.sum("n").alias("n")).filter(F.col("n") > group_rows).collect()}

    @K.lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, forest = ["leaf", "i", "j", "b", "c", "n", "leaves", "v"], shared.value
        for b in batches:
            for at, x in _vectors(b, 2):
                row, leaf = forest.leaves_of(unit(x))
                bounds = np.searchsorted(row, np.arange(len(at) + 1))
                c = b.column(0).to_numpy()[at]
                blocks = np.array([-(-sizes.get(int(q), 1) // block_rows) for q in leaf])
                mine = (c[row].astype(np.uint64) >> np.uint64(8)) % blocks.astype(np.uint64)
                times = np.repeat(np.arange(len(row)), blocks)
                other = np.arange(len(times)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                own = mine[times].astype(np.int64)
                take = pa.array(at[row[times]])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(leaf))
                yield pa.RecordBatch.from_arrays([pa.array(leaf[times]), pa.array(np.minimum(own, other)), pa.array(np.maximum(own, other)), pa.array(own), b.column(0).take(take), b.column(1).take(take), lists.take(pa.array(row[times])), b.column(2).take(take)], names=names)

    placed = classes.select("c", "n", "v").mapInArrow(place, f"leaf long, i long, j long, b long, c long, n long, leaves array<long>, v array<{kind}>")
    found = table(placed.groupBy("leaf", "i", "j").applyInPandas(lambda g: _compare(g, cosine, block_rows), "c long, links long, root long"), "found")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("c").alias("a"), F.col("root").alias("b")))
    known = classes.select("c", "n", "least").join(links, "c", "left").join(parts.withColumnRenamed("node", "c"), "c", "left").withColumn("component", F.coalesce("component", "c"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    result = table(known.join(least, "component").select("c", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "near")
    joined = rows.select("id", "c").join(result, "c", "left")
    component = F.when(F.col("n_links") > 0, F.col("component_id")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
