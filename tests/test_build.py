import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.operators import ivf, layout, pca
from vecloom.sources import formats, index_files


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = (rng.standard_normal((120, 6)) * [3, 2, 1, 1, 0.5, 0.1]).astype(np.float32)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").cache()


def test_balanced_is_the_serial_matching(vectors, spark):
    x, base = vectors
    centroids = ivf.sample_centroids(base, 7)
    near = ivf.nearest(base, centroids, 7).cache()
    got = {r["vec_id"]: r["cluster_id"] for r in ivf.balanced(near, 18, 7, None).collect()}
    lists = {}
    for r in near.orderBy("vec_id", "probe_rank").collect():
        lists.setdefault(r["vec_id"], []).append(r["cluster_id"])
    count, want = [0] * 7, {}
    for v in range(120):
        want[v] = next(c for c in lists[v] if count[c] < 18)
        count[want[v]] += 1
    assert got == want
    for wishes in (1, 2):  # some vectors find all their candidates full and go to the emptiest cluster in turn
        few = {r["vec_id"]: r["cluster_id"] for r in ivf.balanced(near.filter(f"probe_rank <= {wishes}"), 18, 7, None).collect()}
        count, want, full = [0] * 7, {}, 0
        for v in range(120):
            c = next((c for c in lists[v][:wishes] if count[c] < 18), None)
            full += c is None
            want[v] = count.index(min(count)) if c is None else c
            count[want[v]] += 1
        assert few == want and (full or wishes > 1)
    seeded = ivf.balanced(near.filter("probe_rank = 1"), 18, 7).groupBy("cluster_id").count().collect()
    assert sum(r["count"] for r in seeded) == 120 and max(r["count"] for r in seeded) <= 18
    with pytest.raises(ValueError):
        ivf.balanced(near, 17, 7)


def test_overlap(vectors):
    _, base = vectors
    centroids = ivf.sample_centroids(base, 7)
    labels, near = ivf.assign(base, centroids), ivf.nearest(base, centroids, 7)
    rows = ivf.overlap_lists(labels, near, 15, 7).collect()
    sizes = {c: sum(r["cluster_id"] == c for r in rows) for c in range(7)}
    before = {r["cluster_id"]: r["count"] for r in labels.groupBy("cluster_id").count().collect()}
    assert all(sizes[c] == max(15, before.get(c, 0)) for c in range(7))
    given = [r["vec_id"] for r in rows if r["padded"]]
    assert len(given) == len(set(given))
    with pytest.raises(ValueError):
        ivf.overlap_lists(labels, near, 60, 7)


def test_lists_and_checks(vectors, spark):
    _, base = vectors
    centroids = ivf.sample_centroids(base, 3)
    far = centroids.unionByName(spark.createDataFrame([(3, [1e6] * 6)], "cluster_id int, centroid array<float>"))
    sizes = ivf.cluster_sizes(ivf.assign(base, far), far)
    assert sizes.filter("cluster_id = 3").first()["num_vectors"] == 0
    assert ivf.size_stats(sizes).first()["empty"] == 1
    ivf.check_labels(ivf.assign(base, far), 4)
    with pytest.raises(ValueError):
        ivf.check_labels(ivf.assign(base, far), 1)
    with pytest.raises(ValueError):
        ivf.check_members(spark.createDataFrame([(0, 999)], "cluster_id int, vec_id long"), base)


def test_kmeans_blocks(vectors, monkeypatch):
    """Lloyd iterations by hand, with blocks of one row; a cluster that nothing is near keeps its centroid."""
    x, base = vectors
    monkeypatch.setattr(ivf, "BLOCK_CELLS", 4)
    spark = base.sparkSession
    start = np.vstack([x[:4], np.full((1, 6), 1e6)]).astype(np.float32)
    want = start.copy()
    for _ in range(3):
        label = ((x[:, None].astype(float) - want[None].astype(float)) ** 2).sum(axis=2).argmin(axis=1)
        want = np.array([x[label == c].astype(float).mean(axis=0) if (label == c).any() else want[c] for c in range(5)]).astype(np.float32)
    first = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(start)], "cluster_id long, centroid array<float>")
    got = ivf.kmeans(base, 5, 3, centroids=first).orderBy("cluster_id").collect()
    assert np.allclose([r["centroid"] for r in got], want, rtol=1e-6)


def test_kmeans_falls(vectors):
    _, base = vectors
    costs = [ivf.assign(base, ivf.kmeans(base, 5, n)).agg(F.sum("dist")).first()[0] for n in (0, 1, 4)]
    assert costs[0] >= costs[1] >= costs[2]


def test_pca(vectors, spark, tmp_path):
    x, base = vectors
    model = pca.fit(base, 4, whiten=True)
    want = np.linalg.eigvalsh(np.cov(x.T.astype(float)))[::-1][:4]
    assert np.allclose(model.explained_variance, want, rtol=1e-5)
    assert np.allclose(model.components @ model.components.T, np.eye(4), atol=1e-9)
    a = {r["vec_id"]: r["rotated"] for r in pca.transform_rows(base, model).collect()}
    b = (x - model.mean) @ model.components.T / np.sqrt(model.explained_variance)
    assert len(a) == len(x) and all(np.allclose(a[i], b[i]) for i in a)
    formats.save_pca(spark, str(tmp_path / "m"), model)
    back = formats.load_pca(spark, str(tmp_path / "m"))
    assert back.whiten and np.allclose(back.components, model.components, atol=1e-6)
    formats.save_pca_npz(str(tmp_path / "m.npz"), model)
    assert np.allclose(formats.load_pca_npz(str(tmp_path / "m.npz")).mean, model.mean)
    with pytest.raises(ValueError):
        pca.PcaModel(np.zeros(3), np.zeros((2, 4)), np.zeros(2))


def test_randomized_pca(vectors, spark):
    x, base = vectors
    for n in (1, 3, 6):
        model, exact = pca.fit_randomized(base, n, whiten=True), pca.fit(base, n)
        assert np.allclose(model.mean, exact.mean) and model.whiten
        assert np.allclose(model.explained_variance, exact.explained_variance, rtol=1e-6)
        assert np.allclose(model.components, exact.components, atol=1e-4)
    wide = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", "embedding").repartition(70)
    model, exact = pca.fit_randomized(wide, 8), pca.fit(wide, 8)
    assert np.allclose(model.explained_variance, exact.explained_variance, rtol=1e-3)
    assert np.allclose(model.components @ model.components.T, np.eye(8), atol=1e-9)
    few = pca.fit_randomized(base.limit(2), 4)  # two vectors have one direction
    assert few.explained_variance[0] > 0 and np.allclose(few.explained_variance[1:], 0, atol=1e-9)
    with pytest.raises(ValueError):
        pca.fit_randomized(base.limit(0), 2)
    with pytest.raises(ValueError):
        pca.fit_randomized(base, 7)


def test_vector_files(vectors, spark, tmp_path):
    x, base = vectors
    path = str(tmp_path / "x.fvecs")
    formats.write_fvecs(base, path)
    back = formats.read_fvecs(spark, path, 6).orderBy("vec_id").collect()
    assert [r["vec_id"] for r in back] == list(range(120)) and np.array_equal(np.array([r["embedding"] for r in back], np.float32), x)
    formats.write_ivecs(spark.createDataFrame([(2, [3, 4]), (1, [7, 8])], "qid long, gt array<int>"), str(tmp_path / "g.ivecs"))
    assert [tuple(r) for r in formats.read_ivecs(spark, str(tmp_path / "g.ivecs"), 1).orderBy("qid").collect()] == [(1, [7]), (2, [3])]
    with pytest.raises(ValueError):
        formats.read_fvecs(spark, path, 5)
    data = open(path, "rb").read()
    (tmp_path / "short.fvecs").write_bytes(data[:-1])
    (tmp_path / "none.fvecs").write_bytes(b"")
    (tmp_path / "mixed.fvecs").write_bytes(data[:28] + b"\x05" + data[29:56])
    for name in ("short", "none"):
        with pytest.raises(ValueError):
            formats.read_fvecs(spark, str(tmp_path / f"{name}.fvecs"))
    with pytest.raises(Exception, match="dimensions"):
        formats.read_fvecs(spark, str(tmp_path / "mixed.fvecs")).collect()


def test_index_parts(spark):
    rng = np.random.default_rng(1)
    c = rng.standard_normal((3, 4)).astype(np.float32)
    assert np.array_equal(formats.parse_centroids(formats.format_centroids(c), 4), c)
    assert formats.parse_u32_list(formats.format_u32_list(np.array([5, 1])), 2).tolist() == [5, 1]
    raw = formats.format_members(np.array([0, 2, 2, 3]), np.array([4, 4, 1]))
    assert [x.tolist() for x in formats.parse_members(raw)] == [[0, 2, 2, 3], [4, 4, 1]]
    book = rng.standard_normal((2, 3, 2)).astype(np.float32)
    assert np.array_equal(formats.parse_codebooks(formats.format_codebooks(book)), book)
    assert formats.parse_codes(formats.format_codes(np.array([[1, 255]]))).tolist() == [[1, 255]]
    for parse, data in ((formats.parse_centroids, formats.format_centroids(c)[:-1]), (formats.parse_u32_list, b"\x09\0\0\0"), (formats.parse_members, formats.format_members(np.array([0, 3, 2]), np.array([1, 2]))), (formats.parse_codebooks, b"\0" * 24)):
        with pytest.raises(ValueError):
            parse(data)


@pytest.mark.parametrize(("magic", "version"), [(index_files.SINGLE, 1), (index_files.PLACED, 1), (index_files.SHARDED, 1), (index_files.SHARDED, 2), (index_files.QUANTIZED, 1)])
def test_index_files(magic, version, spark):
    c = np.arange(8, dtype=np.float32).reshape(2, 4)
    header = {"magic": magic, "version": version, "dim": 4, "nlist": 2, "num_vectors": 5, "sector_size": 4096, "base_lba": 7, "shard_dim": 4, "num_shards": 2, "vectors_per_lba": 256, "shard_dims": [2, 2], "shard_offsets": [0, 2], "shard_bytes": [8, 8], "shard_vectors_per_lba": [512, 512], "num_disks": 4, "pq_m": 2, "pq_ksub": 3, "pq_nbits": 8, "pq_subdim": 2, "pq_code_bytes": 2}
    books = np.ones((2, 3, 2), np.float32) if magic == index_files.QUANTIZED else None
    data = index_files.build(header, [{"cluster_id": 0, "num_vectors": 3, "start_lba": 7, "num_lbas": 1}, {"cluster_id": 1, "num_vectors": 2, "start_lba": 8, "num_lbas": 1, "sorted_id_base": 3}], c, books)
    head, clusters, centroids, back = index_files.parse(data)
    assert head["base_lba"] == 7 and np.array_equal(centroids, c) and (back is None) == (books is None)
    frame = index_files.clusters_frame(spark, clusters).orderBy("cluster_id").collect()
    assert [r["sorted_id_base"] for r in frame] == [0, 3] and [r["num_vectors"] for r in frame] == [3, 2]
    if magic == index_files.SHARDED:
        assert index_files.HEADERS[magic].itemsize == 88 and head["shard_vectors_per_lba"][0] == (512 if version == 2 else 256)
    for bad in (data[:-1], data[:20], b"\1\2\3\4" + data[4:], index_files.build(header, [{"cluster_id": 1}, {"cluster_id": 0}], c, books)):
        with pytest.raises(ValueError):
            index_files.parse(bad)


def test_layout(spark):
    with pytest.raises(ValueError):
        layout.shard_plan(64, [32, 31])
    with pytest.raises(ValueError):
        layout.shard_plan(2000, [2000])
    with pytest.raises(ValueError):
        layout.disk_shards([0, 0, 2], 3)
    assert layout.stage_disks([2, 1, 1]) == [(0, 0), (0, 1), (1, 2), (2, 3)]
    bundles = spark.createDataFrame([(1, 0, 0, b) for b in (0, 1, 3, 7, 8, 9)], "qid int, cluster_id int, batch int, bundle int")
    runs = lambda **k: sorted((r["first"], r["last"]) for r in layout.read_runs(bundles, **k).collect())
    assert runs(gap=0) == [(0, 1), (3, 3), (7, 9)]
    assert runs(gap=1) == [(0, 3), (7, 9)]
    assert runs(gap=1, most=2) == [(0, 1), (3, 3), (7, 8), (9, 9)]
