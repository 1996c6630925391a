"""A layered proximity graph over centroids, for finding the nearest clusters without comparing all of them.

Every centroid is in layer 0; a layer above holds a hashed 1 / `degree` of the one below, until a few are left. Within a
layer a node keeps up to `degree` links: of its nearest nodes those that no kept one is nearer to, and then links that
others have to it, by the same rule. All nodes of a layer are linked at once, in tasks; a search goes down the layers with a
beam, for a block of queries at a time, over flat arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from vecloom.operators.ivf import centroid_matrix
from vecloom.operators.topk import BLOCK_CELLS
from vecloom.sources.shared import table

DEGREE, BUILD_WIDTH, SEARCH_WIDTH, ENTRY_WIDTH = 32, 80, 128, 16
MERGED = 512  # nodes whose candidates are held at a time
AT_ONCE = 4  # nodes of a beam that are opened in one step
LINKS = "layer int, node long, links array<long>"


def _sizes(n: int, degree: int) -> list[int]:
    """Nodes of each layer, from 0 up: a `degree`-th of the one before, while more than `degree` are left."""
    out = [n]
    while out[-1] > 4 * degree:
        out.append(-(-out[-1] // degree))
    return out


def _kept(x: np.ndarray, node: np.ndarray, near: np.ndarray, dist: np.ndarray, degree: int) -> np.ndarray:
    """Of each node's candidates `near` (-1: none), in order of `dist`, those that are nearer to the node than to any kept one,
    up to `degree`; places that are left go to the nearest of the others. Rows of -1-padded links."""
    order = np.argsort(dist, axis=1, kind="stable")
    near, dist = np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1)
    n, width = near.shape
    keep = np.zeros((n, width), bool)
    for j in range(width):
        v = x[np.maximum(near[:, j], 0)]
        ok = (near[:, j] >= 0) & (near[:, j] != node) & (keep.sum(axis=1) < degree)
        for i in range(j):
            both = ok & keep[:, i]
            if both.any():
                d = ((x[near[both, i]] - v[both]) ** 2).sum(axis=1)
                ok[np.flatnonzero(both)[d < dist[both, j]]] = False
        keep[:, j] = ok
    rank = np.where(keep, 0, np.where((near >= 0) & (near != node[:, None]), 1, 2)) * width + np.arange(width)
    best = np.argsort(rank, axis=1)[:, :degree]
    links = np.take_along_axis(near, best, 1)
    return np.where(np.take_along_axis(rank, best, 1) < 2 * width, links, -1)


def _own(x: np.ndarray, members: np.ndarray, nodes: np.ndarray, degree: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(nodes, links) by blocks: each node's links of its `width` nearest in the layer of `members`."""
    y = x[members]
    half = (y * y).sum(axis=1) / 2
    k, step = min(width + 1, len(members)), max(1, BLOCK_CELLS // len(members))
    for s in range(0, len(nodes), step):
        here = nodes[s : s + step]
        score = half[None] - x[here] @ y.T
        at = np.argpartition(score, k - 1, axis=1)[:, :k]
        dist = 2 * np.take_along_axis(score, at, 1) + (x[here] ** 2).sum(axis=1)[:, None]
        yield here, _kept(x, here, members[at], dist, degree)


def in_memory(ids: np.ndarray, matrix: np.ndarray, degree: int = DEGREE, width: int = BUILD_WIDTH, seed: int = 42) -> Layers:
    """The graph over so few rows that one task holds it; `build` by arrays."""
    x = matrix.astype(np.float64)
    key = np.array([hash_of(int(i), seed) for i in ids], np.uint64)
    rank, out = np.argsort(np.argsort(key, kind="stable")), []
    for size in _sizes(len(ids), degree):
        members = np.flatnonzero(rank < size)
        own = np.concatenate([links for _, links in _own(x, members, members, degree, width)])
        row, col = np.nonzero(own >= 0)
        node, other = members[row], own[row, col]
        back = np.lexsort((key[node], other))  # links to a node, hashed; the first `width` count
        turn = np.arange(len(back)) - np.searchsorted(other[back], other[back])
        back = back[turn < width]
        pairs = np.unique(np.stack([np.concatenate([node, other[back]]), np.concatenate([other, node[back]])]), axis=1)
        links = np.full((size, degree), -1)
        for s in range(0, size, MERGED):
            here = members[s : s + MERGED]
            lo, hi = np.searchsorted(pairs[0], here), np.searchsorted(pairs[0], here, side="right")
            near = np.full((len(here), max(1, (hi - lo).max())), -1)
            n = hi - lo
            near[np.repeat(np.arange(len(here)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = pairs[1, lo[0] : hi[-1]]
            dist = np.where(near >= 0, ((x[np.maximum(near, 0)] - x[here][:, None]) ** 2).sum(axis=2), np.inf)
            kept = _kept(x, here, near, dist, degree)
            links[s : s + MERGED, : kept.shape[1]] = kept
        out.insert(0, (members, links))
    return Layers(ids, matrix, (x**2).sum(axis=1).astype(np.float32), out)


def build(centroids: DataFrame, degree: int = DEGREE, width: int = BUILD_WIDTH, seed: int = 42) -> DataFrame:
    """(layer, node, links) over (cluster_id, centroid), as a written table. The centroids are broadcast (`centroid_matrix` bounds
    their bytes); links of a node that many others are linked to are cut to the `width` nearest before they meet."""
    spark = centroids.sparkSession
    ids, matrix = centroid_matrix(centroids)
    rank = np.argsort(np.argsort([hash_of(int(i), seed) for i in ids]))
    found = None
    for layer, size in enumerate(_sizes(len(ids), degree)):
        members = np.flatnonzero(rank < size)
        shared = spark.sparkContext.broadcast((matrix, members))
        nodes = spark.createDataFrame([(int(m),) for m in members], "node long").repartition(min(size, 4 * spark.sparkContext.defaultParallelism))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            x, members = shared.value
            x = x.astype(np.float64)
            for b in batches:
                for here, links in _own(x, members, b.column(0).to_numpy(), degree, width):
                    yield _links(here, links)

        def merged(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            x = shared.value[0].astype(np.float64)
            for b in batches:
                if not b.num_rows:
                    continue
                node, lists = b.column(0).to_numpy(), b.column(1).to_pylist()
                near = np.full((len(node), max(1, *(len(r) for r in lists))), -1)
                for i, r in enumerate(lists):
                    near[i, : len(r)] = r
                dist = np.where(near >= 0, ((x[np.maximum(near, 0)] - x[node][:, None]) ** 2).sum(axis=2), np.inf)
                yield _links(node, _kept(x, node, near, dist, degree))

        own = table(nodes.mapInArrow(nearest, "node long, links array<long>"), "links")
        edges = own.select("node", F.explode("links").alias("other"))
        back = edges.select(F.col("other").alias("node"), F.col("node").alias("other"))
        turn = F.row_number().over(W.partitionBy("node").orderBy(F.xxhash64("other"), "other"))
        some = back.withColumn("r", turn).filter(F.col("r") <= width).select("node", "other")
        both = edges.union(some).groupBy("node").agg(F.collect_set("other").alias("links"))
        here = both.mapInArrow(merged, "node long, links array<long>").select(F.lit(layer).alias("layer"), "node", "links")
        found = here if found is None else found.unionByName(here)
    named = spark.createDataFrame([(i, int(c)) for i, c in enumerate(ids)], "at long, id long")  # a row for each cluster
    flat = found.select("layer", "node", F.posexplode("links").alias("pos", "other"))
    flat = flat.join(named.withColumnsRenamed({"at": "node", "id": "node_id"}), "node").join(named.withColumnsRenamed({"at": "other", "id": "other_id"}), "other")
    rows = flat.groupBy("layer", F.col("node_id").alias("node")).agg(F.array_sort(F.collect_list(F.struct("pos", "other_id"))).alias("l"))
    return table(rows.select("layer", "node", F.col("l.other_id").alias("links")), "graph")


def hash_of(value: int, seed: int) -> int:
    """64 well-mixed bits of an integer."""
    x = (value * 0x9E3779B97F4A7C15 + seed * 0xC2B2AE3D27D4EB4F + 1) & 0xFFFFFFFFFFFFFFFF
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = ((x ^ (x >> shift)) * factor) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


def _links(node: np.ndarray, links: np.ndarray) -> pa.RecordBatch:
    real = links >= 0
    at = np.concatenate([[0], np.cumsum(real.sum(axis=1))])
    return pa.RecordBatch.from_arrays([pa.array(node), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(links[real].astype(np.int64)))], names=["node", "links"])


@dataclass
class Layers:
    """The graph as flat arrays: centroid ids, their matrix and squared norms, and for each layer, from the top down, its nodes
    and their links (rows of `matrix`, -1 for none)."""

    ids: np.ndarray
    matrix: np.ndarray
    norms: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]

    def nearest(self, q: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Rows of the k nearest centroids found for each query (-1 where fewer were reached), nearest first."""
        out = np.full((len(q), k), -1)
        step = max(1, (16 << 20) // max(1, len(self.ids)))  # of what has been seen, a byte for each query and centroid
        for s in range(0, len(q), step):
            block = q[s : s + step].astype(np.float32)
            entry = np.broadcast_to(self.layers[0][0][:ENTRY_WIDTH], (len(block), min(ENTRY_WIDTH, len(self.layers[0][0]))))
            for n, (nodes, links) in enumerate(self.layers):
                entry = self._beam(block, entry, nodes, links, max(width, k) if n == len(self.layers) - 1 else ENTRY_WIDTH)
            found = entry[:, :k]
            out[s : s + step, : found.shape[1]] = found
        return out

    def _distance(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, self.norms[at] - 2 * np.einsum("bd,bnd->bn", q, self.matrix[at]), np.inf)

    def _beam(self, q: np.ndarray, entry: np.ndarray, nodes: np.ndarray, links: np.ndarray, width: int) -> np.ndarray:
        b = np.arange(len(q))[:, None]
        row = np.full(len(self.ids) + 1, -1)  # place of a centroid in the layer
        row[nodes] = np.arange(len(nodes))
        seen = np.zeros((len(q), len(self.ids) + 1), bool)
        at, d = np.full((len(q), width), -1), np.full((len(q), width), np.inf, np.float32)
        n = min(width, entry.shape[1])
        at[:, :n], d[:, :n] = entry[:, :n], self._distance(q, entry[:, :n])
        seen[b, at] = True
        opened = at < 0
        while True:
            key = np.where(opened, np.inf, d)
            pick = np.argsort(key, axis=1)[:, :AT_ONCE]
            live = np.isfinite(np.take_along_axis(key, pick, 1))
            if not live.any():
                break
            np.put_along_axis(opened, pick, True, 1)
            centers = np.where(live, np.take_along_axis(at, pick, 1), -1)
            new = np.where((centers >= 0)[:, :, None], links[row[centers]], -1).reshape(len(q), -1)
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1  # once each
            new = np.where(seen[b, new], -1, new)
            seen[b, new] = True
            seen[:, -1] = False
            both, dist = np.hstack([at, new]), np.hstack([d, self._distance(q, new).astype(np.float32)])
            was = np.hstack([opened, new < 0])
            order = np.argsort(dist, axis=1, kind="stable")[:, :width]
            at, d, opened = (np.take_along_axis(v, order, 1) for v in (both, dist, was))
        return at


def layers(centroids: DataFrame, graph: DataFrame) -> Layers:
    """The graph on the driver; its size is bounded by the number of clusters times the degree."""
    ids, matrix = centroid_matrix(centroids)
    order = np.argsort(ids)
    place = lambda v: order[np.searchsorted(ids[order], v)]
    rows = graph.toArrow()
    out = []
    for layer in sorted(set(rows["layer"].to_pylist()), reverse=True):
        mine = rows.filter(pc.equal(rows["layer"], layer)).sort_by("node")
        lists = mine["links"].combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        links = np.full((len(n), max(1, n.max(initial=0))), -1)
        links[np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)] = place(lists.flatten().to_numpy())
        out.append((place(mine["node"].to_numpy()), links))
    if not out:  # one centroid has no links
        out = [(np.arange(len(ids)), np.full((len(ids), 1), -1))]
    return Layers(ids, matrix, (matrix.astype(np.float64) ** 2).sum(axis=1).astype(np.float32), out)
