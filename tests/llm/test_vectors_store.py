"""Embedding near-duplicates, the token store, the pipeline."""

import collections
import math
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from vecloom.llm import store, vectors

ODD_TEXTS = [None, "", " ", "short", "the same passage of some length that comes again " * 60, "x" * 3000, "<|endoftext|> a"]


def brute(rows):
    n = len(rows)
    ok = [v is not None and len(v) > 0 and all(c is not None and math.isfinite(c) for c in v) and any(v) for _, v in rows]
    label, links = list(range(n)), [0] * n
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                    links[i] += 1
                    links[j] += 1
                    old, new = label[i], label[j]
                    label = [new if x == old else x for x in label]
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[label[i]] = min(least.get(label[i], rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], least.get(label[i]) if links[i] else rows[i][0]) for i in range(n)]


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(8)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(c + 1):
            rows.append((len(rows), (centre + rng.standard_normal(16) * rng.choice([0.05, 0.2, 0.3])).astype(np.float32).tolist()))
    rows += [(len(rows) + i, rng.standard_normal(16).astype(np.float32).tolist()) for i in range(150)]
    k = len(rows)
    rows += [(k, None), (k + 1, [0.0] * 16), (k + 2, [math.nan] * 16), (k + 3, [None] + [1.0] * 15), (k + 4, [math.inf] * 16), (k + 5, []), (k + 6, [1.0, 2.0]), (k + 7, [2.0, 4.0]), (k + 8, [1e38] * 16), (k + 9, [1e-38] * 16)]
    return [*rows, rows[5], rows[5], (None, rows[40][1]), (None, [7.0, 1.0, 1.0])]


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 16}, {"block_rows": 16, "group_rows": 16}, {"fit_rows": 40}, {"fit_rows": 40, "block_rows": 50}])
def test_forest(cloud, sizes, spark, monkeypatch):
    monkeypatch.setattr(vectors, "TOP_ROWS", 40)
    monkeypatch.setattr(vectors, "LEAF_ROWS", 40)
    df = spark.createDataFrame(cloud, "vec_id long, embedding array<float>").selectExpr("*", "1 as c", "2 as n", "'x' as v", "0 as leaf").repartition(3)
    got = vectors.near_vectors(df, **sizes).collect()
    want = collections.Counter(brute(cloud))
    found = collections.Counter((r["vec_id"], r["n_links"], r["component_id"]) for r in got)
    assert sum((want & found).values()) >= 0.99 * len(cloud) and sum(found.values()) == len(cloud)
    assert sum(r["n_links"] for r in got) >= 0.99 * sum(n for _, n, _ in want.elements())
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)
    assert vectors.near_vectors(df.filter("vec_id < -1")).count() == 0


def test_recall_on_data(spark):
    """All pairs of the largest small table with copies of it that are moved a little."""
    from pyspark.sql import functions as F

    base = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding")
    moved = base.select((F.col("vec_id") + 1000).alias("vec_id"), F.transform("embedding", lambda x, i: (x + 0.02 * F.sin(i * F.col("vec_id"))).cast("float")).alias("embedding"))
    both = base.unionByName(moved)
    rows = both.orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    links = (x @ x.T >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(both).collect()}
    assert sum(links) > 0 and all(got[r["vec_id"]] <= n for r, n in zip(rows, links, strict=True))
    assert sum(got.values()) >= 0.99 * links.sum()


@pytest.mark.parametrize(("total", "most_copies", "recall"), [(10**8, 16, 0.92), (10**9, 24, 0.9)])
def test_leaves_keep_their_size(total, most_copies, recall):
    """A bounded sample makes trees for any number of rows: leaves of some 10,000 rows, few copies of a row, and pairs just above
    the threshold together in a leaf."""
    rng = np.random.default_rng(1)
    forest = vectors.Forest(list(rng.standard_normal((vectors.FIT_ROWS, 64)).astype(np.float32)), total, vectors.TREES, 0.95)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    noise = rng.standard_normal(x.shape)
    noise -= (noise * x).sum(axis=1)[:, None] * x
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    row, leaf = forest.leaves_of(x)
    pairs = set(zip(row.tolist(), leaf.tolist(), strict=True))
    near = forest.leaves_of(0.951 * x + np.sqrt(1 - 0.951**2) * noise)
    together = {r for r, q in zip(*(v.tolist() for v in near), strict=True) if (r, q) in pairs}
    assert len(together) >= recall * len(x)
    assert len(row) / len(x) < most_copies
    assert len(row) / len(x) * total / forest.leaves < 12_000  # mean rows of a leaf
    counts = np.bincount(leaf, minlength=forest.leaves) * (total / len(x))
    sizes = np.sort(counts.reshape(-1)[: forest.leaves // 100 * 100].reshape(-1, 100).mean(axis=1)) if total == 10**8 else counts[:0]
    assert not len(sizes) or np.median(sizes) < 12_000


def test_trees_route_by_their_nodes():
    """The batch goes the way that each vector goes by itself."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((3000, 8))
    tree = vectors.Tree(x, 3000, 0.1, [1], 100)
    assert tree.leaves > 30
    d = x @ tree._directions(tree.levels)
    want = set()
    for i in range(200):
        todo = [0]
        while todo:
            node = todo.pop()
            if node < 0:
                want.add((i, -node - 1))
                continue
            v = d[i, tree.column[node]] - tree.cut[node]
            todo += [tree.left[node]] * int(v <= 0.1) + [tree.right[node]] * int(v >= -0.1)
    got = [(int(r), int(q)) for r, q in zip(*tree.leaves_of(x), strict=True) if r < 200]
    assert set(got) == want and len(got) == len(want)
    alike = vectors.Tree(np.ones((500, 8)), 500, 0.1, [1], 100)
    assert alike.leaves == 1 and alike.leaves_of(np.ones((3, 8)))[1].tolist() == [0, 0, 0]


def test_recall_at_depth(spark, monkeypatch):
    """Pairs just above the threshold in trees of several levels, fitted on a part of the rows, whose leaves are split on."""
    monkeypatch.setattr(vectors, "TOP_ROWS", 300)
    monkeypatch.setattr(vectors, "LEAF_ROWS", 24)
    rng = np.random.default_rng(5)
    a = rng.standard_normal((3000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    noise = rng.standard_normal((3000, 64))
    noise -= (noise * a).sum(axis=1)[:, None] * a
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    c = rng.uniform(0.9505, 0.96, 3000)[:, None]
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * noise]).astype(np.float32)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>").repartition(3)
    y = x.astype(float)
    y /= np.linalg.norm(y, axis=1)[:, None]
    want = (y @ y.T >= 0.95).sum(axis=1) - 1
    got = {r["vec_id"]: r["n_links"] for r in vectors.near_vectors(df, fit_rows=600, block_rows=200).collect()}
    assert want.sum() >= 6000 and all(got[i] <= n for i, n in enumerate(want.tolist()))
    print("recall", sum(got.values()) / want.sum())
    assert sum(got.values()) >= 0.95 * want.sum()


@pytest.fixture(scope="module")
def path():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_store(spark, path, tmp_path, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    data = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = data + [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(500, data[3][1]), (500, data[3][1]), (None, data[4][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as start", "'x' as copy", "2 as seq", "3 as n").repartition(3)
    folder = str(tmp_path / "store")
    store.write_store(df, folder, path)
    start, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))))
        start += len(ids)
    got = store.read_report(spark, folder).collect()
    assert sorted((tuple(r)[:4] for r in got), key=lambda r: r[1]) == want
    for r in store.read_ids(spark, folder).collect():
        assert (r["doc_id"], r["start"], len(r["ids"]) // 4, zlib.crc32(r["ids"])) in want
    files = sorted((tmp_path / "store/recipes").glob("*.parquet"))
    order = [(r["part"], r["at"], -1 if r["doc_id"] is None else r["doc_id"]) for f in files for r in pq.read_table(f).to_pylist()]
    assert order == sorted(order) and [r[2] for r in order] == sorted(r[2] for r in order)
    chunks = store._chunks(spark, folder)
    assert chunks.count() == chunks.select("digest").distinct().count() < sum(r["n_chunks"] for r in got)
    assert spark.read.parquet(f"{folder}/manifest").agg({"n_docs": "sum"}).first()[0] == len(rows)
    assert store.store_report(df.filter("doc_id < -1"), path).count() == 0


def test_damage(spark, path, tmp_path):
    """Whatever is lost or changed in a store is an error."""
    import shutil

    texts = [" ".join(f"w{i * k % 97}" for k in range(900)) for i in range(60)]
    df = spark.createDataFrame([(i * 10**9, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    whole = tmp_path / "whole"
    store.write_store(df, str(whole), path)
    assert store.read_report(spark, str(whole)).count() == 60
    kinds = {"chunks": "data/kind=chunks", "recipes": "recipes", "manifest": "manifest"}
    for name, place in kinds.items():
        for how in ("file", "row"):
            folder = tmp_path / f"{name}-{how}"
            shutil.copytree(whole, folder)
            files = sorted((folder / place).glob("*.parquet"))
            for crc in folder.rglob("*.crc"):
                crc.unlink()
            if how == "file" and len(files) > 1:
                files[0].unlink()
            else:
                rows = pq.read_table(files[0], partitioning=None)
                if name == "chunks":
                    ids = rows["ids"].to_pylist()
                    rows = rows.set_column(rows.schema.get_field_index("ids"), "ids", [[bytes(len(ids[0])), *ids[1:]]])
                pq.write_table(rows if name == "chunks" else rows.slice(1), files[0])
            with pytest.raises(Exception, match="damaged"):
                store.read_report(spark, str(folder)).collect()


def test_cuts_and_crcs():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 50_000, 60_000)
    ids[30_000:55_000] = 7  # no cut by content for 25,000 ids
    bounds = np.array([0, 0, 10, 20_000, 60_000])
    cuts = store.cut_points(ids, bounds)
    assert set(bounds[1:].tolist()) - {0} <= set(cuts.tolist()) and cuts[-1] == 60_000
    assert np.diff(cuts, prepend=0).max() <= store.MOST_IDS
    moved = store.cut_points(np.concatenate([ids[:100], ids[:20_000]]), np.array([0, 20_100]))
    assert len(set((moved - 100).tolist()) & set(cuts.tolist())) > 20  # the same passage, the same cuts
    a, b = [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 5000)], [bytes(rng.integers(0, 256, n).astype(np.uint8)) for n in (70_000, 0, 3)]
    got = store.join_crc(np.array([zlib.crc32(x) for x in a]), np.array([zlib.crc32(x) for x in b]), np.array([len(x) for x in b]))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]
    assert store.merkle_root([b"a" * 32]) == b"a" * 32 and store.merkle_root([b"a", b"b", b"c"]) != store.merkle_root([b"a", b"c", b"b"])


def test_pipeline(spark, sf_dir):
    pytest.importorskip("corpus_pipeline")
    import hashlib

    import corpus_pipeline
    import public_tokenizers
    import tiktoken

    from vecloom.llm import jaccard, mixing, quality
    from vecloom.llm.encode import read_ranks

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 4
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).schema == docs.schema
    good = {r["doc_id"] for r in quality.score_quality(docs).filter("kept").collect()}
    kept = docs.filter(docs["doc_id"].isin(good))
    first = {r["doc_id"] for r in jaccard.jaccard_components(kept).filter("doc_id = component_id").collect()}
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix_report(kept.filter(kept["doc_id"].isin(first))).collect()}
    coder = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = collections.Counter()
    for r in docs.collect():
        if copies.get(r["doc_id"]):
            ids = coder.encode_ordinary(r["text"])
            want[r["doc_id"], len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += copies[r["doc_id"]]
    assert collections.Counter(tuple(r) for r in corpus_pipeline.run(spark, sf_dir).collect()) == want


def test_queries_have_names():
    from vecloom.llm import queries

    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}
    assert set(queries.oracle_sql()) <= names
