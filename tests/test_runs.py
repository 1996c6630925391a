"""Measured runs and the command line."""

import csv

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom import __main__ as cli
from vecloom.operators.topk import exact_knn
from vecloom.plans import metrics, runs, search
from vecloom.plans.params import PqParams, SearchParams, StagedParams
from vecloom.sources import catalog, formats
from vecloom.streaming.queries import latency_windows


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    """Vectors in a file, a model and an index, all by the command line."""
    path = tmp_path_factory.mktemp("cli")
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(12, 8))[rng.integers(0, 12, 400)] * 5 + rng.normal(size=(400, 8))).astype(np.float32)
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    formats.write_fvecs(base, str(path / "x.fvecs"))
    queries = base.filter("vec_id < 30").cache()
    formats.write_fvecs(queries, str(path / "q.fvecs"))
    truth = search.ground_truth(base, queries.select((F.col("vec_id") + 1).alias("qid"), F.col("embedding").alias("q")))
    formats.write_ivecs(truth.select("qid", F.col("gt").cast("array<int>").alias("gt")), str(path / "gt.ivecs"))
    cli.main(f"pca fit --input {path}/x.fvecs --model {path}/pca --n-components 8 --randomized".split())
    cli.main(f"pca transform --input {path}/x.fvecs --model {path}/pca --output {path}/r.fvecs".split())
    cli.main(f"train --input {path}/x.fvecs --output {path}/model --nlist 12 --niter 5 --pq-m 4 --pq-ksub 32".split())
    cli.main(f"build --input {path}/x.fvecs --model {path}/model --output {path}/index --shard-dims 4,4 --codes --graph --buckets 12 --members {path}/m".split())
    cli.main(f"build --input {path}/x.fvecs --model {path}/model --output {path}/overlap --lists overlap --target-size 20 --candidates 12 --buckets 3".split())
    return path, x


def test_pca_by_command(built, spark):
    path, x = built
    got = np.array([r["embedding"] for r in formats.read_fvecs(spark, str(path / "r.fvecs")).orderBy("vec_id").collect()])
    d = lambda y: ((y[:, None] - y[None]) ** 2).sum(axis=2)
    assert np.allclose(d(got[:40]), d(x[:40].astype(float)), rtol=1e-3, atol=1e-3)  # all components: a rotation


@pytest.mark.parametrize("mode", ["flat", "staged", "pq"])
def test_search_by_command(built, spark, tmp_path, mode):
    path, _ = built
    for backend in ("brute", "graph"):
        cli.main(f"search --index {path}/index --queries {path}/q.fvecs --truth {path}/gt.ivecs --mode {mode} --nprobe 12 --batches 3 --coarse-backend {backend} --output {tmp_path}/{backend} --report {tmp_path}/report".split())
        found = spark.read.parquet(f"{tmp_path}/{backend}")
        assert found.select("qid").distinct().count() == 30
    lines = [r for f in (tmp_path / "report").glob("*.csv") for r in csv.DictReader(f.open())]
    assert len(lines) == 2
    for r in lines:
        assert int(r["queries"]) == 30 and float(r["recall"]) > 0.95 and float(r["qps"]) > 0
        assert 0 < int(r["p50_us"]) <= int(r["p99_us"]) <= int(r["wall_us"]) and int(r["input_bytes"]) > 0 and int(r["shuffle_write_bytes"]) > 0


def test_overlapping_index(built, spark):
    path, _ = built
    index = catalog.load(spark, f"{path}/overlap")
    assert index.clusters.agg(F.min("num_vectors")).first()[0] >= 20
    assert index.lists.count() > 400 and index.lists.select("slot").distinct().count() == index.lists.count()


def test_meter(built, spark):
    path, _ = built
    index = catalog.load(spark, f"{path}/index")
    queries = formats.read_fvecs(spark, str(path / "q.fvecs")).select((F.col("vec_id") + 1).alias("qid"), F.col("embedding").alias("q"))
    for params in (SearchParams(12), StagedParams(12, shard_dims=(4, 4)), PqParams(12, m=4, rerank_k=400)):
        found, report, meter = runs.measured(index, queries, params, batches=2)
        assert sum(meter.rows(f"batch{b}") for b in (0, 1)) == found.count() == 300
        stages = meter.stage_figures()
        assert stages.agg(F.sum("input_bytes")).first()[0] == meter.total("input_bytes") == report.first()["input_bytes"] > 0
        assert stages.filter("tasks < 1").isEmpty() and report.first()["recall"] == 0.0  # without truth
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, exact_knn(formats.read_fvecs(spark, str(path / "x.fvecs")), queries).select(*found.columns).collect()))


def test_latency_sketches(spark):
    rows = spark.range(10_000).select((F.col("id") * 10).alias("latency_us"), (F.col("id") % 4).alias("part"))
    parts = metrics.latency_sketch(rows, ["part"])
    assert parts.count() == 4
    (got,) = metrics.latency_quantiles(parts).collect()
    assert got["n"] == 10_000
    for name, q in (("p50_us", 0.5), ("p95_us", 0.95), ("p99_us", 0.99)):
        assert abs(got[name] / 100_000 - q) < 0.03
    assert [r["n"] for r in metrics.latency_quantiles(parts, ["part"]).collect()] == [2500] * 4


def test_csv_appends(spark, tmp_path):
    for n in (1, 2):
        metrics.write_csv(spark.createDataFrame([(n, 0.5)], "n int, recall double"), str(tmp_path / "r"))
    assert sorted(r["n"] for r in spark.read.csv(str(tmp_path / "r"), header=True).collect()) == ["1", "2"]


def test_latency_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 00:00:10", 100), ("2024-01-01 00:00:50", 300), ("2024-01-01 00:01:10", 50)], "t string, latency_us long").select(F.to_timestamp("t").alias("finished"), "latency_us")
    got = sorted((r["start"].minute, r["queries"], r["avg_latency_us"]) for r in latency_windows(rows).collect())
    assert got == [(0, 2, 200.0), (1, 1, 50.0)]
