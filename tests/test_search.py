import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions.distance import fold_l2, l2, prefix_l2
from vecloom.operators import graph, ivf, layout, pq, thresholds
from vecloom.operators.topk import exact_knn, recall
from vecloom.plans import metrics, scanning, search
from vecloom.plans.params import PqParams, SearchParams, StagedParams
from vecloom.sources import catalog
from vecloom.sources.catalog import Index

DIM, NLIST = 8, 6


@pytest.fixture(scope="module")
def world(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((150, DIM)).astype(np.float32)
    x[10] = x[11]  # a tie
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").cache()
    queries = base.filter("vec_id % 20 = 0").select((F.col("vec_id") + 1).alias("qid"), F.col("embedding").alias("q")).cache()
    centroids = ivf.sample_centroids(base, NLIST).cache()
    lists = ivf.inverted_lists(ivf.assign(base, centroids).join(base, "vec_id").select("vec_id", "cluster_id", "embedding")).cache()
    sizes = ivf.cluster_sizes(ivf.assign(base, centroids), centroids)
    extents = layout.extents(sizes, [64]).cache()
    index = Index(lists, centroids, extents)
    return {"x": x, "index": index, "base": base, "queries": queries, "centroids": centroids, "lists": lists, "extents": extents}


def rows(df):
    return sorted(tuple(r) for r in df.select("qid", "rank", "vec_id", "dist").collect())


def test_exact_and_whole_probe(world):
    exact = rows(exact_knn(world["base"], world["queries"]))
    for q in range(0, 150, 20):
        d = fold_l2(world["x"], world["x"][q : q + 1])[:, 0]
        want = sorted(range(150), key=lambda i: (d[i], i))[:10]
        assert [r[2] for r in exact if r[0] == q + 1] == want
    assert rows(search.ivf_flat(world["index"], world["queries"], SearchParams(NLIST))) == exact
    staged = search.staged(world["index"], world["queries"], StagedParams(NLIST, shard_dims=(3, 3, 2)))
    assert rows(staged.top()) == exact  # the sampled threshold is a bound
    with pytest.raises(ValueError):
        search.ivf_flat(world["index"], world["queries"], SearchParams(NLIST + 1))


def test_max_queries(world):
    for n in (1, 2, 21):  # the first n queries, whose ids are 1, 21, 41, ...
        found = search.ivf_flat(world["index"], world["queries"], SearchParams(2, max_queries=n))
        assert {r[0] for r in rows(found)} == set(range(1, 151, 20)[:n])


def saved(world, spark, path, shards=None, buckets=3):
    books = pq.sample_codebooks(world["base"], 4, DIM, 16)
    catalog.save(Index(world["lists"], world["centroids"], world["extents"], pq.encode(world["base"], books), books), path, shards, buckets)
    return catalog.load(spark, path)


def test_searches_through_the_graph(world, spark, tmp_path):
    books = pq.sample_codebooks(world["base"], 4, DIM, 16)
    made = Index(world["lists"], world["centroids"], world["extents"], pq.encode(world["base"], books), books, graph.build(world["centroids"]))
    catalog.save(made, str(tmp_path / "a"), (4, 4), 3)
    index = catalog.load(spark, str(tmp_path / "a"))
    for backend in ("graph", "faiss"):  # so few centroids that the beam holds them all
        assert rows(search.ivf_flat(index, world["queries"], SearchParams(3, coarse_backend=backend))) == rows(search.ivf_flat(index, world["queries"], SearchParams(3)))
    staged = StagedParams(3, shard_dims=(4, 4), coarse_backend="graph")
    assert rows(search.staged(index, world["queries"], staged).top()) == rows(search.staged(index, world["queries"], StagedParams(3, shard_dims=(4, 4))).top())
    with pytest.raises(ValueError):
        search.ivf_flat(world["index"], world["queries"], SearchParams(3, coarse_backend="graph"))


def test_rerank_of_everything_is_flat(world, spark, tmp_path):
    books = pq.sample_codebooks(world["base"], 4, DIM, 16)
    index = Index(world["lists"], world["centroids"], world["extents"], pq.encode(world["base"], books), books)
    flat = rows(search.ivf_flat(world["index"], world["queries"], SearchParams(3)))
    for each in (index, saved(world, spark, str(tmp_path / "a")), saved(world, spark, str(tmp_path / "b"), [5, 3])):
        scan = search.adc_scan(each, world["queries"], PqParams(3, m=4, rerank_k=150))
        assert rows(search.rerank(each, scan, world["queries"], 10)) == flat
    with pytest.raises(ValueError):
        search.adc_scan(index, world["queries"], PqParams(3, m=2))
    with pytest.raises(ValueError):
        search.adc_scan(world["index"].__class__(world["lists"], world["centroids"], world["extents"], None, books), world["queries"], PqParams(3, m=4)).collect()
    with pytest.raises(ValueError):
        pq.subdim_of(DIM, 3)


def serial_stages(world, params, limits):
    """(qid, vec_id) -> number of stages survived, by hand."""
    probes = {}
    for r in ivf.probes(world["queries"], world["centroids"], params.nprobe).collect():
        probes.setdefault(r["qid"], set()).add(r["cluster_id"])
    out = {}
    for e in world["lists"].collect():
        for q, clusters in probes.items():
            if e["cluster_id"] in clusters:
                alive = 0
                for s, end in enumerate(params.ends):
                    if fold_l2(np.array([e["embedding"][:end]]), world["x"][q - 1 : q, :end])[0, 0] > limits[q] * params.proportions[s]:
                        break
                    alive += 1
                out[q, e["vec_id"]] = alive
    return out


@pytest.mark.parametrize("stored", [None, (4, 4), (5, 3)])
def test_stages(world, spark, tmp_path, monkeypatch, stored):
    monkeypatch.setattr(scanning, "BLOCK_CELLS", 8)
    params = StagedParams(3, shard_dims=(4, 4), prune_threshold_mode="centroid", prune_proportions=(0.5, 1.0))
    index = world["index"] if stored is None else saved(world, spark, str(tmp_path / "a"), stored)
    run = search.staged(index, world["queries"], params, keep_stages=True)
    limits = {r["qid"]: r["threshold"] for r in thresholds.centroid(ivf.probes(world["queries"], world["centroids"], 3), 3).collect()}
    want = serial_stages(world, params, limits)
    for s, rows_ in enumerate(run.stages):
        assert sorted((r["qid"], r["vec_id"]) for r in rows_.collect()) == sorted(k for k, n in want.items() if n > s)
    counted = {(r["qid"], r["stage"]): (r["n_in"], r["n_out"], r["n_pruned"], r["bytes"]) for r in run.counters().collect()}
    for (q, s), (n_in, n_out, pruned, size) in counted.items():
        mine = [n for (p, _), n in want.items() if p == q]
        assert (n_in, n_out) == (sum(n >= s for n in mine), sum(n > s for n in mine)) and pruned == n_in - n_out and size == n_in * 16
    reads = {r["stage"]: r for r in run.reads(index).collect()}
    assert reads[1]["entries"] == len({v for (_, v), n in want.items() if n > 0}) < reads[0]["entries"]
    assert reads[1]["full_bytes"] == reads[0]["entries"] * 16
    run.scratch.clear()


def test_batches_of_queries(world, spark, tmp_path, monkeypatch):
    """Queries that come in many batches find the same."""
    whole = rows(search.ivf_flat(world["index"], world["queries"], SearchParams(3)))
    staged = rows(search.staged(world["index"], world["queries"], StagedParams(3, shard_dims=(4, 4))).top())
    batches = scanning.query_batches
    monkeypatch.setattr(scanning, "query_batches", lambda *a, **k: batches(*a, **{**k, "most": 200}))
    assert len(list(scanning.query_batches(world["queries"], ivf.probes(world["queries"], world["centroids"], 3)))) > 2
    assert rows(search.ivf_flat(world["index"], world["queries"], SearchParams(3))) == whole
    assert rows(search.staged(world["index"], world["queries"], StagedParams(3, shard_dims=(4, 4))).top()) == staged
    none = world["queries"].filter("qid < 0")
    assert search.ivf_flat(world["index"], none, SearchParams(3)).collect() == []
    assert search.staged(world["index"], none, StagedParams(3, shard_dims=(4, 4))).top().collect() == []


def plan(df):
    return df._jdf.queryExecution().toString()


def test_reads_what_is_probed(world, spark, tmp_path):
    """One query probing one cluster reads one bucket; a later stage reads its own segment, behind a Bloom filter of survivors."""
    index = saved(world, spark, str(tmp_path / "a"), (4, 4), buckets=NLIST)
    one = world["queries"].filter("qid = 21")
    (batch,) = scanning.query_batches(one, ivf.probes(one, world["centroids"], 1))
    found = scanning.nearest_entries(index, batch, 10)
    bucket = int(batch.clusters[0] % NLIST)
    assert "PartitionFilters: [bucket" in plan(found) or "PartitionFilters: [isnotnull(bucket" in plan(found)
    files = [r[0] for r in index.entries("slot", buckets=batch.buckets(index)).select(F.input_file_name()).distinct().collect()]
    assert files and all(f"bucket={bucket}/" in f for f in files)
    wanted = spark.createDataFrame([(21, (int(batch.clusters[0]) << 32) + 1, 5, 0.0)], scanning.FOUND)
    path = str(tmp_path / "wanted")
    wanted.write.parquet(path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with scanning.runtime_filters(spark):
            joined = scanning.fetch(index, spark.read.parquet(path), "seg:4:8")
            text = plan(joined)
            assert len(joined.collect()) == 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "might_contain" in text
    physical = text[text.index("== Physical Plan ==") :]
    assert "seg1" in physical and "seg0" not in physical and "vec_id#" in physical
    assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold") != "0"


def test_threshold_borders(spark):
    lists = spark.createDataFrame([(0, 0, 1, [1.0, 0.0]), (0, 1, 2, [1.0, 1.0]), (0, 2, 3, [math.nan, 0.0]), (0, 3, 3, [math.nan, 0.0])], "cluster_id long, local_idx long, vec_id long, embedding array<float>")
    batch = scanning.QueryBatch(np.array([1]), np.zeros((1, 2), np.float32), np.array([0]), np.array([0]), np.array([1.0]))
    index = Index(lists, None, None)
    ids = lambda df: sorted(r["vec_id"] for r in df.collect())
    first = scanning.entries_under(index, batch, 1, 1.0)
    assert ids(first) == [1, 2, 3, 3]  # equal stays, NaN stays, a vector in two places stays twice
    assert ids(scanning.extended(scanning.fetch(index, first, "seg:1:2"), batch, 1, 2, 1.0)) == [1, 3, 3]
    assert ids(scanning.entries_under(index, batch, 1, 0.0)) == [3, 3]
    top = scanning.nearest_entries(index, batch, 10).collect()
    assert [r["vec_id"] for r in top] == [1, 2, 3, 3]  # NaN is last
    with pytest.raises(Exception, match="2 values"):
        scanning.nearest_entries(Index(lists.withColumn("embedding", F.slice("embedding", 1, 1)), None, None), batch, 1).collect()


def test_thresholds_fall_back(spark):
    rows_ = spark.createDataFrame([(1, 0.0), (2, math.nan), (3, math.inf), (4, None), (5, 2.5)], "qid long, dist double")
    assert [r[0] for r in rows_.orderBy("qid").select(thresholds.usable(F.col("dist"))).collect()] == [1e6] * 4 + [2.5]


def test_recall(spark):
    found = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7), (3, 1, 1)], "qid long, rank long, vec_id long")
    truth = spark.createDataFrame([(1, [6, 9, 5]), (2, [8])], "qid long, gt array<int>")
    queries = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "qid long")
    truth = truth.unionByName(spark.createDataFrame([(4, [7, 8]), (9, [1])], "qid long, gt array<int>").select(*truth.columns))
    got = recall(found, truth, queries)
    assert sorted(map(tuple, got.collect())) == [(1, 0.5, 2), (2, 0.0, 1), (3, -1.0, 1), (4, 0.0, 0), (5, -1.0, 0)]
    assert metrics.run_summary(got).first()[:2] == (5, 0.1)  # a query that finds nothing counts


def test_engines_agree(world):
    pairs = world["base"].crossJoin(world["queries"]).select("vec_id", "qid", l2(F.col("embedding"), F.col("q")).alias("d"), prefix_l2(F.col("embedding"), F.col("q"), [3, DIM]).alias("p")).collect()
    d = fold_l2(world["x"], world["x"])
    assert all(r["d"] == d[r["vec_id"], r["qid"] - 1] == r["p"][1] for r in pairs)


@pytest.mark.parametrize("bad", [{"nprobe": 0}, {"read_depth": 300}, {"gap_merge": -1}, {"coarse_backend": "x"}])
def test_params(bad):
    with pytest.raises(ValueError):
        SearchParams(**bad)


@pytest.mark.parametrize("bad", [{"shard_dims": ()}, {"shard_dims": (1,) * 5}, {"prune_threshold_mode": "centroids"}, {"prune_proportions": (1.0,)}, {"prune_proportions": (-1.0, 1, 1, 1)}])
def test_staged_params(bad):
    with pytest.raises(ValueError):
        StagedParams(**bad)


def test_stream(world, spark, tmp_path):
    from vecloom.streaming.queries import search_stream

    source = str(tmp_path / "in")
    world["queries"].write.parquet(source)
    run = search_stream(world["index"], spark.readStream.schema(world["queries"].schema).parquet(source), SearchParams(3), str(tmp_path / "out"), str(tmp_path / "check"))
    run.processAllAvailable()
    run.stop()
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(search.ivf_flat(world["index"], world["queries"], SearchParams(3)))


def test_catalog(world, spark, tmp_path):
    want = rows(search.ivf_flat(world["index"], world["queries"], SearchParams(3)))
    for i, shards in enumerate([(4, 4), None]):
        back = saved(world, spark, str(tmp_path / str(i)), shards)
        assert (back.buckets, back.shard_dims) == (3, shards or ())
        assert rows(search.ivf_flat(back, world["queries"], SearchParams(3))) == want
        assert back.entries("cluster_id", "slot").select(catalog.cluster_of(F.col("slot")) == F.col("cluster_id")).distinct().collect() == [(True,)]
    spark.read.parquet(str(tmp_path / "0" / "clusters")).withColumn("num_vectors", F.lit(7)).write.parquet(str(tmp_path / "bad" / "clusters"))
    for name in ("lists", "centroids", "layout", "codebooks"):
        (tmp_path / "bad" / name).symlink_to(tmp_path / "0" / name)
    with pytest.raises(ValueError):
        catalog.load(spark, str(tmp_path / "bad"))
