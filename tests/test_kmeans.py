"""Training of centroids."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import ivf, kmeans

DATA = "/root/testdata/sf0.1"


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id long, embedding array<float>").repartition(4)


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(20, 6)) * 20
    x = (centers[rng.integers(0, 20, 1500)] + rng.normal(size=(1500, 6)) * 0.3).astype(np.float32)
    return x, frame(spark, x).cache()


def sizes(base, centroids):
    return {r["cluster_id"]: r["num_vectors"] for r in ivf.cluster_sizes(ivf.assign(base, centroids), centroids).collect()}


def test_one_pass(blobs):
    x, base = blobs
    c = x[:7]
    for cells in (7, 100, 1 << 20):
        got = kmeans.one_pass(base, c, cells)
        d = ((x[:, None].astype(float) - c[None].astype(float)) ** 2).sum(axis=2)
        label = d.argmin(axis=1)
        assert got.counts.tolist() == np.bincount(label, minlength=7).tolist()
        assert got.cost == pytest.approx(d.min(axis=1).sum(), rel=1e-9)
        for k in range(7):
            assert np.allclose(got.sums[k], x[label == k].astype(float).sum(axis=0))
            assert got.far[k] == pytest.approx(d[label == k, k].max(), rel=1e-6)
            assert got.x[k].tolist() in x[label == k].tolist()


def test_seeds_find_all_blobs(blobs):
    x, base = blobs
    found = kmeans.seeds(base, 20, seed=3)
    assert np.array_equal(found, kmeans.seeds(base.repartition(7), 20, seed=3))
    cost = kmeans.lloyd(base, found, 5)[1]
    first = kmeans.lloyd(base, ivf.centroid_matrix(ivf.sample_centroids(base, 20))[1], 5)[1]
    assert cost < 1500 * 6 * 0.3**2 * 1.2 < first  # one centroid a blob; rows of the data miss some


def test_cost_on_data(spark):
    """No dearer than Lloyd from rows of the data, with as many iterations, and restarts take the best."""
    base = spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id", "embedding").cache()
    plain = kmeans.cost(base, ivf.kmeans(base, 32, 5))
    assert kmeans.cost(base, kmeans.fit(base, 32, 5)) <= plain * 1.001
    costs = [kmeans.cost(base, kmeans.fit(base, 32, 2, seed=s)) for s in (42, 43)]
    assert kmeans.cost(base, kmeans.fit(base, 32, 2, n_init=2)) == pytest.approx(min(costs), rel=1e-9)


def test_sample(blobs):
    x, base = blobs
    some = kmeans.sampled(base, 500, 1)
    assert 400 < some.count() < 600 and some.rdd.getNumPartitions() == base.rdd.getNumPartitions()
    assert kmeans.sampled(base, 1500, 1).count() == 1500
    assert kmeans.cost(base, kmeans.fit(base, 20, 5, sample_rows=500)) < 1500 * 6 * 0.3**2 * 1.3


def test_minibatch(blobs):
    x, base = blobs
    start = kmeans.seeds(base, 20, seed=3)
    # By hand: the rate of a centroid is the batch's share of all it has got.
    got = kmeans.minibatch(base, start, 4, passes=2)
    batch = {r["vec_id"]: r["b"] for r in base.select("vec_id", F.pmod(F.xxhash64("vec_id", F.lit(42)), F.lit(4)).alias("b")).collect()}
    c, seen = start.astype(float), np.zeros(20)
    for b in [*range(4), *range(4)]:
        rows = x[[i for i in range(1500) if batch[i] == b]].astype(float)
        label = ((rows[:, None] - c.astype(np.float32).astype(float)[None]) ** 2).sum(axis=2).argmin(axis=1)
        n = np.bincount(label, minlength=20)
        seen += n
        for k in np.flatnonzero(n):
            c[k] += (rows[label == k].sum(axis=0) - n[k] * c[k]) / seen[k]
    assert np.allclose(got, c, rtol=1e-4, atol=1e-4)
    assert kmeans.one_pass(base, got).cost < 1500 * 6 * 0.3**2 * 1.3


def test_no_empty_cluster(blobs, spark):
    x, base = blobs
    start = np.vstack([x[:1], x[:1] + 1e4, x[:1] - 1e4, x[:1] + 2e4, x[1:6]]).astype(np.float32)
    first = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(start)], "cluster_id long, centroid array<float>")
    assert 0 in sizes(base, ivf.kmeans(base, 9, 3, centroids=first)).values()
    got = ivf.kmeans(base, 9, 3, centroids=first, min_points=1)
    assert min(sizes(base, got).values()) >= 1
    assert kmeans.cost(base, got) < kmeans.cost(base, ivf.kmeans(base, 9, 3, centroids=first))
    assert min(sizes(base, kmeans.fit(base, 60, 4, min_points=3)).values()) >= 1
    alike = frame(spark, np.ones((50, 3)))
    assert sorted(sizes(alike, kmeans.fit(alike, 4, 3, min_points=1)).values())[-1] == 50  # nothing to split
    with pytest.raises(ValueError):
        kmeans.fit(alike.limit(0), 4)
    some = alike.unionByName(spark.createDataFrame([(99, None)], "vec_id long, embedding array<float>"))
    assert kmeans.cost(some, kmeans.fit(some, 1, 1)) == 0
