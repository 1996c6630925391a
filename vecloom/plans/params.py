"""Parameters of the searches, checked when they are made."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field


@dataclass(frozen=True)
class SearchParams:
    """nprobe clusters per query, k results; max_queries 0 takes all. `coarse_backend`: `brute` compares all centroids, `graph` (or
    `faiss`) goes through the index's layered graph with a beam of `coarse_width`. Read depth, gaps and similar knobs
    belong to Spark's readers."""

    nprobe: int = 32
    k: int = 10
    max_queries: int = 0
    coarse_backend: str = "brute"
    coarse_width: int = 128
    read_depth: int = 8
    gap_merge: int = 0

    def __post_init__(self) -> None:
        if self.nprobe < 1 or self.k < 1 or self.max_queries < 0:
            raise ValueError("nprobe and k are positive, max_queries is not negative")
        if self.coarse_backend not in ("brute", "graph", "faiss") or self.coarse_width < 1:
            raise ValueError("coarse_backend is brute, graph or faiss, and coarse_width is positive")
        if not 1 <= self.read_depth <= 256 or not 0 <= self.gap_merge <= 256:
            raise ValueError("read_depth lies between 1 and 256, gap_merge between 0 and 256")


@dataclass(frozen=True)
class StagedParams(SearchParams):
    """Stages by dimensions, with a factor on the threshold for each."""

    shard_dims: Sequence[int] = field(default=(16, 16, 16, 16))
    prune_threshold_mode: str = "sampled"
    prune_proportions: Sequence[float] | None = None

    def __post_init__(self) -> None:
        super().__post_init__()
        if not 1 <= len(self.shard_dims) <= 4 or min(self.shard_dims) < 1:
            raise ValueError("there are one to four stages")
        if self.prune_threshold_mode not in ("centroid", "sampled"):
            raise ValueError("prune_threshold_mode is centroid or sampled")
        p = self.proportions
        if len(p) != len(self.shard_dims) or any(not math.isfinite(x) or x < 0 for x in p):
            raise ValueError("there is one finite, non-negative proportion for each stage")

    @property
    def proportions(self) -> Sequence[float]:
        return self.prune_proportions if self.prune_proportions is not None else (1.0,) * len(self.shard_dims)

    @property
    def ends(self) -> list[int]:
        return [sum(self.shard_dims[: i + 1]) for i in range(len(self.shard_dims))]


@dataclass(frozen=True)
class PqParams(SearchParams):
    """rerank_k candidates by code are compared exactly."""

    m: int = 8
    rerank_k: int = 100
    cluster_threads: int = 1

    def __post_init__(self) -> None:
        super().__post_init__()
        if self.m < 1 or self.rerank_k < 1 or self.cluster_threads < 1:
            raise ValueError("m, rerank_k and cluster_threads are positive")
