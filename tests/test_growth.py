"""What must not grow faster than the tables."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions.distance import fold_l2, pair_l2, product_l2
from vecloom.operators import coarse, graph, ivf, layout, topk
from vecloom.plans import scanning, search
from vecloom.plans.params import SearchParams, StagedParams
from vecloom.sources import catalog
from vecloom.sources.catalog import Index
from vecloom.sources.shared import shared_folder

DIM, NLIST = 8, 5


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    x = np.random.default_rng(8).standard_normal((900, DIM)).astype(np.float32)
    x[30], x[41, 2], x[42, 1] = x[31], math.nan, math.inf
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").cache()
    queries = base.filter("vec_id % 20 = 0").select((F.col("vec_id") + 1).alias("qid"), F.col("embedding").alias("q")).cache()
    centroids = ivf.sample_centroids(base.filter("vec_id not in (41, 42)"), NLIST).cache()
    labels = ivf.assign(base, centroids).cache()
    lists = ivf.inverted_lists(labels.join(base, "vec_id").select("vec_id", "cluster_id", "embedding"))
    path = str(tmp_path_factory.mktemp("growth") / "index")
    catalog.save(Index(lists, centroids, layout.extents(ivf.cluster_sizes(labels, centroids), [64])), path, (3, 5), 3)
    return x, base, queries, catalog.load(spark, path)


def tuples(df):
    return sorted(repr(tuple(r)) for r in df.collect())  # NaN equals itself


@pytest.mark.parametrize("mode", ["sampled", "centroid"])
def test_staged_search_writes_no_survivors(world, spark, monkeypatch, mode):
    """All figures of a staged search come from scans; no table of pairs is written, whatever passes."""
    _, _, queries, index = world
    params = StagedParams(3, shard_dims=(3, 5), prune_threshold_mode=mode, prune_proportions=(0.7, 1.0))
    kept = search.staged(index, queries, params, keep_stages=True)
    per, folder = 7, shared_folder(spark).removeprefix("file://")
    first = kept.stages[0].select("qid", catalog.cluster_of(F.col("slot")).alias("cluster_id"), catalog.place_of(F.col("slot")).alias("local_idx"))
    wanted = first.select("qid", "cluster_id", F.floor(F.col("local_idx") / 256).alias("batch"), F.floor(F.col("local_idx") / per).alias("bundle"))
    reads = tuples(layout.read_runs(wanted, 0).groupBy("qid").agg(F.count("*").alias("reads"), F.sum(F.col("last") - F.col("first") + 1).alias("sectors")))
    want = [tuples(kept.top()), tuples(kept.counters()), tuples(kept.reads(index)), reads]
    kept.scratch.clear()
    monkeypatch.setattr(topk, "TILE", 50)
    tables = lambda: {f for f in os.listdir(folder) if f.startswith("vecloom-stage-")}
    before, run = tables(), search.staged(index, queries, params)
    assert [tuples(run.top()), tuples(run.counters()), tuples(run.reads(index)), tuples(run.first_reads(per))] == want
    assert tables() == before
    run.scratch.clear()


def test_groups_that_are_cut(world, monkeypatch):
    """Reads are the same where places that are read together come to several tasks."""
    _, _, queries, index = world
    params = StagedParams(5, shard_dims=(3, 5), prune_threshold_mode="centroid")
    whole = tuples(search.staged(index, queries, params).first_reads(60))
    rows = index.lists.repartition(7)
    apart = Index(rows.withColumn("embedding", F.concat("seg0", "seg1")).drop("seg0", "seg1"), index.centroids, index.clusters)
    assert tuples(search.staged(apart, queries, params).first_reads(60)) == whole
    with pytest.raises(ValueError, match="bundles of 4"):
        search.staged(apart, queries, params).first_reads(4)


def test_only_the_nearest_are_summed(world, monkeypatch):
    """The exact search sums the dimensions of few pairs; the others are ruled out by products."""
    x, base, queries, index = world
    rng = np.random.default_rng(2)
    far = rng.standard_normal((3000, 16)) * 10.0 ** rng.integers(-3, 4, (3000, 1))
    d, slack = product_l2(far, far[:50])
    assert (np.abs(d - fold_l2(far, far[:50])) <= slack).all()
    summed = []
    monkeypatch.setattr(topk, "pair_l2", lambda x, q, row, at: summed.append(len(row)) or pair_l2(x, q, row, at))
    best, ids, asks = topk.Nearest(50, 10), np.arange(3000), np.arange(50)
    best.compare(far, ids, ids, far[:50], asks)
    exact = fold_l2(far, far[:50])
    assert (best.i == np.lexsort((np.broadcast_to(ids[:, None], exact.shape), exact), axis=0)[:10].T).all()
    assert sum(summed) < 50 * 3000 / 10
    q = queries.filter("qid in (1, 41)")
    d = fold_l2(x, x[[0, 40]])
    order = [np.lexsort((np.arange(900), c))[:900] for c in d.T]
    got = topk.exact_knn(base.repartition(3), q, 900).orderBy("qid", "rank").collect()
    assert [r["vec_id"] for r in got if r["qid"] == 1] == order[0].tolist()  # not finite ones are last
    flat = search.ivf_flat(index, q, SearchParams(NLIST, k=900)).orderBy("qid", "rank").collect()
    assert [r["vec_id"] for r in flat if r["qid"] == 41] == order[1].tolist()


def test_join_is_of_parts(world, monkeypatch):
    """No pair of vectors is a row: groups give k rows a query, whatever parts they are dealt into."""
    _, base, queries, _ = world
    want = tuples(topk.exact_knn(base, queries))
    odd = base.unionByName(base.sparkSession.createDataFrame([(5000, None), (5001, [0.0])], base.schema))
    assert tuples(topk.exact_knn_join(odd, queries)) == want
    monkeypatch.setattr(topk, "PART_ROWS", 13)
    assert tuples(topk.exact_knn_join(odd, queries)) == want
    plan = topk.exact_knn_join(base, queries)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_graph_in_parts(spark):
    """A task holds the graph of a part only, and the parts together find what one graph does."""
    x = np.random.default_rng(4).standard_normal((1500, 6)).astype(np.float32)
    nodes = spark.createDataFrame([(3 * i, v.tolist()) for i, v in enumerate(x)] + [(7, None)], "cluster_id long, centroid array<float>")
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x[:60])] + [(70, None)], "qid long, q array<float>")
    d = fold_l2(x[:60], x)
    want = np.argsort(d, axis=1, kind="stable")[:, :10] * 3
    for part_nodes in (10_000, 200):
        rows = coarse.graph_in_parts(nodes, queries, 10, part_nodes).collect()
        got = {q: {r["cluster_id"] for r in rows if r["qid"] == q} for q in range(60)}
        assert len(rows) == 600 and np.mean([len(got[q] & set(want[q].tolist())) for q in range(60)]) > 9.5
        assert all(r["dist"] == d[r["qid"], r["cluster_id"] // 3] for r in rows)
    for n in (1, 2, 40):
        layers = graph.in_memory(np.arange(n), x[:n])
        assert (np.sort(layers.nearest(x[:1], n)) == np.arange(n)).all()
    assert coarse.graph_in_parts(nodes, queries.filter("qid < 0"), 10).collect() == []


def test_codes_are_scanned_by_tiles():
    """A scan of codes holds blocks of bounded cells and sorts those only that may be among the nearest."""
    seen = np.zeros((2500, 3000), int)
    for r, s in topk.tiles(2500, 3000):
        assert (r.stop - r.start) * (s.stop - s.start) <= topk.TILE**2
        seen[r, s] += 1
    assert (seen == 1).all()
    d = np.random.default_rng(5).integers(0, 50, (3000, 20)) / 7.0  # many ties, as codes have
    best, ids, asks = topk.Nearest(20, 10), np.arange(3000)[::-1].copy(), np.arange(20)
    for s in range(0, 3000, 700):
        row, at = np.nonzero(best.likely(d[s : s + 700], asks))
        best.add(at, d[s + row, at], ids[s + row], ids[s + row])
    order = np.lexsort((np.broadcast_to(ids[:, None], d.shape), d), axis=0)[:10].T
    assert (best.i == ids[order]).all()


def test_few_pairs_that_are_left_are_not_multiplied_again(monkeypatch):
    """After a stage that leaves few pairs the others are summed pair by pair, with the same verdicts and sums."""
    x = np.random.default_rng(4).standard_normal((700, 24)).astype(np.float32)
    x[3, 2], x[4, 1], x[10] = math.nan, math.inf, x[11]
    q, ends = x[::3].astype(np.float64), [9, 15, 24]
    asks, limits, calls = np.arange(len(q)), np.tile([4.0, 9.0, 12.0], (len(q), 1)), []
    monkeypatch.setattr(scanning, "product_l2", lambda *a: calls.append(1) or product_l2(*a))
    want = [fold_l2(x[:, :e], q[:, :e]) for e in ends]
    seen = np.zeros((3, len(x), len(q)), bool)
    for r, s, stage, alive, d, slack in scanning._pruned(x, q, limits, asks, ends):
        seen[stage, r, s] = alive
        exact = want[stage][r, s]
        near = np.abs(d - exact) <= slack
        assert near[alive & np.isfinite(exact)].all()
    passed = np.ones_like(seen[0])
    for stage in range(3):
        passed &= ~(want[stage] > limits[0, stage])
        assert (seen[stage] == passed).all()
    assert 0 < passed.sum() < passed.size / 8
    assert len(calls) == len(list(topk.tiles(len(x), len(q))))
