"""Command line: `python -m vecloom COMMAND ...`.

pca     fit principal components of an fvecs file or folder, or transform by a model
train   centroids (k-means), and codebooks with --pq-m
build   an index: assignment (plain, balanced or overlapping), lists, extents, codes, graph
search  flat, staged or quantized search of an index, with results and a report
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.operators import graph, ivf, kmeans, layout, pca, pq
from vecloom.plans import metrics, runs
from vecloom.plans.params import PqParams, SearchParams, StagedParams
from vecloom.sources import binary, catalog, formats


def _ints(text: str) -> list[int]:
    return [int(x) for x in text.split(",")]


def _floats(text: str) -> list[float]:
    return [float(x) for x in text.split(",")]


def _vectors(spark: SparkSession, path: str) -> DataFrame:
    """(vec_id, embedding) of fvecs files or of a Parquet table."""
    return spark.read.parquet(path).select("vec_id", "embedding") if path.rstrip("/").endswith(".parquet") else formats.read_fvecs(spark, path)


def _pca(spark: SparkSession, a: argparse.Namespace) -> None:
    base = _vectors(spark, a.input)
    if a.fit:
        fit = pca.fit_randomized if a.randomized else pca.fit
        formats.save_pca(spark, a.model, fit(base, a.n_components, a.whiten))
    else:
        rotated = pca.transform_rows(base, formats.load_pca(spark, a.model)).select("vec_id", F.col("rotated").cast("array<float>").alias("embedding"))
        formats.write_fvecs(rotated, a.output)


def _train(spark: SparkSession, a: argparse.Namespace) -> None:
    base = _vectors(spark, a.input)
    centroids = kmeans.fit(base, a.nlist, a.niter, a.n_init, a.batches, a.min_points, a.sample_rows)
    centroids.write.parquet(f"{a.output}/centroids")
    if a.pq_m:
        pq.train(base, a.pq_m, len(base.first()["embedding"]), a.pq_ksub, a.niter, a.sample_rows).write.parquet(f"{a.output}/codebooks")


def _build(spark: SparkSession, a: argparse.Namespace) -> None:
    base = _vectors(spark, a.input)
    centroids = spark.read.parquet(f"{a.model}/centroids")
    nlist = centroids.count()
    near = ivf.nearest(base, centroids, min(nlist, a.candidates))
    labels = near.filter("probe_rank = 1").select("vec_id", "cluster_id")
    if a.lists == "balanced":
        labels = ivf.balanced(near, a.max_size, nlist)
    elif a.lists == "overlap":
        labels = ivf.overlap_lists(labels, near, a.target_size, nlist).select("vec_id", "cluster_id")
    lists = ivf.inverted_lists(labels.join(base, "vec_id").select("vec_id", "cluster_id", "embedding"))
    dim = len(base.first()["embedding"])
    plan = layout.shard_plan(dim, a.shard_dims or [dim])
    extents = layout.extents(ivf.cluster_sizes(labels, centroids), [p["per_sector"] for p in plan])
    books = spark.read.parquet(f"{a.model}/codebooks") if a.codes else None
    index = catalog.Index(lists, centroids, extents, pq.encode(base, books) if a.codes else None, books, graph.build(centroids) if a.graph else None)
    catalog.save(index, a.output, a.shard_dims, a.buckets)
    if a.members:
        binary.write_members(lists.select("cluster_id", "local_idx", "vec_id"), a.members, nlist)


def _search(spark: SparkSession, a: argparse.Namespace) -> None:
    index = catalog.load(spark, a.index)
    queries = _vectors(spark, a.queries).select((F.col("vec_id") + 1).alias("qid"), F.col("embedding").alias("q"))
    common = {"nprobe": a.nprobe, "k": a.topk, "max_queries": a.max_queries, "coarse_backend": a.coarse_backend, "read_depth": a.read_depth, "gap_merge": a.gap_merge}
    if a.mode == "staged":
        params = StagedParams(**common, shard_dims=index.shard_dims, prune_threshold_mode=a.prune_threshold_mode, prune_proportions=a.prune_proportions)
    elif a.mode == "pq":
        params = PqParams(**common, m=len(index.codebooks.select("part").distinct().collect()), rerank_k=a.rerank_k)
    else:
        params = SearchParams(**common)
    truth = formats.read_ivecs(spark, a.truth, a.topk) if a.truth else None
    found, report, _ = runs.measured(index, queries, params, truth, a.batches)
    if a.output:
        found.write.parquet(a.output)
    if a.report:
        metrics.write_csv(report, a.report)
    report.show(truncate=False, vertical=True)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("vecloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("pca")
    p.add_argument("action", choices=["fit", "transform"])
    p.add_argument("--input", required=True)
    p.add_argument("--model", required=True)
    p.add_argument("--output")
    p.add_argument("--n-components", type=int, default=None)
    p.add_argument("--whiten", action="store_true")
    p.add_argument("--randomized", action="store_true")
    p = sub.add_parser("train")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--nlist", type=int, default=4096)
    p.add_argument("--niter", type=int, default=25)
    p.add_argument("--n-init", type=int, default=1)
    p.add_argument("--batches", type=int, default=0)
    p.add_argument("--min-points", type=int, default=1)
    p.add_argument("--sample-rows", type=int, default=None)
    p.add_argument("--pq-m", type=int, default=0)
    p.add_argument("--pq-ksub", type=int, default=256)
    p = sub.add_parser("build")
    p.add_argument("--input", required=True)
    p.add_argument("--model", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--lists", choices=["plain", "balanced", "overlap"], default="plain")
    p.add_argument("--max-size", type=int, default=20)
    p.add_argument("--target-size", type=int, default=20)
    p.add_argument("--candidates", type=int, default=64)
    p.add_argument("--shard-dims", type=_ints, default=None)
    p.add_argument("--codes", action="store_true")
    p.add_argument("--graph", action="store_true")
    p.add_argument("--buckets", type=int, default=64)
    p.add_argument("--members")
    p = sub.add_parser("search")
    p.add_argument("--index", required=True)
    p.add_argument("--queries", required=True)
    p.add_argument("--truth")
    p.add_argument("--output")
    p.add_argument("--report")
    p.add_argument("--mode", choices=["flat", "staged", "pq"], default="flat")
    p.add_argument("--nprobe", type=int, default=32)
    p.add_argument("--topk", type=int, default=10)
    p.add_argument("--max-queries", type=int, default=0)
    p.add_argument("--batches", type=int, default=1)
    p.add_argument("--coarse-backend", choices=["brute", "graph", "faiss"], default="brute")
    p.add_argument("--prune-threshold-mode", choices=["sampled", "centroid"], default="sampled")
    p.add_argument("--prune-proportions", type=_floats, default=None)
    p.add_argument("--rerank-k", type=int, default=100)
    p.add_argument("--read-depth", type=int, default=8)
    p.add_argument("--gap-merge", type=int, default=0)
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    args.fit = getattr(args, "action", None) == "fit"
    spark = SparkSession.builder.appName(f"vecloom {args.command}").getOrCreate()
    {"pca": _pca, "train": _train, "build": _build, "search": _search}[args.command](spark, args)


if __name__ == "__main__":
    main()
