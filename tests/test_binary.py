"""Vector and index files as data sources."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.sources import binary, formats

RNG = np.random.default_rng(8)


def fvecs(x):
    return b"".join(struct.pack("<i", len(v)) + v.astype("<f4").tobytes() for v in x)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("vecs")
    x = RNG.standard_normal((233, 5)).astype(np.float32)
    for name, part in (("a.fvecs", x[:100]), ("b.fvecs", x[100:101]), ("c.fvecs", x[101:])):
        (path / name).write_bytes(fvecs(part))
    (path / "_SUCCESS").write_bytes(b"")
    return path, x


@pytest.mark.parametrize("split", [24, 500, 1 << 20])
def test_fvecs_folder(spark, folder, split):
    path, x = folder
    df = binary.read(spark, "fvecs", str(path), 5, split)
    assert df.rdd.getNumPartitions() == {24: 233, 500: 13, 1 << 20: 3}[split]
    got = df.orderBy("vec_id").collect()
    assert [r["vec_id"] for r in got] == list(range(233)) and np.array_equal(np.array([r["embedding"] for r in got], np.float32), x)
    plain = spark.read.format("fvecs").load(str(path / "[ac].fvecs")) if split == 500 else None
    assert plain is None or plain.count() == 232


def test_damaged_records(spark, folder, tmp_path):
    path, x = folder
    for name, data in (("empty", b""), ("long", fvecs(x) + b"1"), ("none", struct.pack("<i", 0)), ("negative", struct.pack("<if", -1, 0))):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(ValueError):
            formats.read_fvecs(spark, str(tmp_path / name))
    (tmp_path / "mixed").write_bytes(fvecs(x[:3]) + struct.pack("<i5f", 4, *x[3]) + fvecs(x[4:]))
    with pytest.raises(Exception, match="other than 5"):
        formats.read_fvecs(spark, str(tmp_path / "mixed")).collect()
    with pytest.raises(ValueError):
        binary.read(spark, "fvecs", str(path), 6)
    with pytest.raises(FileNotFoundError):
        binary.read(spark, "fvecs", str(tmp_path / "nowhere" / "x"))


def test_write_in_parallel(spark, folder, tmp_path):
    """All tasks write to one file; it has the same bytes as one written by hand."""
    _, x = folder
    base = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(9)
    binary.write(base, "fvecs", str(tmp_path / "x.fvecs"), ["vec_id"], "embedding")
    assert (tmp_path / "x.fvecs").read_bytes() == fvecs(x)
    assert not (tmp_path / "x.fvecs.writing").exists()
    ids = [7, 3, 2**32 - 1, 0, 5]
    rows = spark.createDataFrame(list(enumerate(ids)), "vec_id long, cluster_id long").repartition(3)
    binary.write(rows, "u32list", f"file://{tmp_path}/labels", ["vec_id"], "cluster_id")
    assert (tmp_path / "labels").read_bytes() == formats.format_u32_list(np.array(ids))
    codes = RNG.integers(0, 256, (77, 6))
    rows = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(codes)], "vec_id long, codes array<short>").repartition(4)
    binary.write(rows, "pqcodes", str(tmp_path / "codes"), ["vec_id"], "codes")
    assert (tmp_path / "codes").read_bytes() == formats.format_codes(codes)
    gt = RNG.integers(0, 99, (30, 4)).astype(np.int32)
    rows = spark.createDataFrame([(i + 1, c.tolist()) for i, c in enumerate(gt)], "qid long, gt array<int>")
    binary.write(rows, "ivecs", str(tmp_path / "gt"), ["qid"], "gt")
    assert [r["gt"] for r in binary.read(spark, "ivecs", str(tmp_path / "gt"), None, 40).orderBy("qid").collect()] == gt.tolist()
    binary.write(base.limit(0), "fvecs", str(tmp_path / "none"), ["vec_id"], "embedding")
    assert (tmp_path / "none").read_bytes() == b""
    with pytest.raises(Exception, match="should have"):
        binary.write(base.withColumn("embedding", F.when(F.col("vec_id") == 50, F.slice("embedding", 1, 2)).otherwise(F.col("embedding"))), "fvecs", str(tmp_path / "y"), ["vec_id"], "embedding")
    assert not (tmp_path / "y").exists()


@pytest.mark.parametrize("split", [4, 16, 100, 1 << 20])
def test_lists_and_codes(spark, tmp_path, split, monkeypatch):
    monkeypatch.setattr(binary, "BATCH_BYTES", 64)
    ids = RNG.integers(0, 2**32, 91)
    (tmp_path / "labels").write_bytes(formats.format_u32_list(ids))
    got = binary.read(spark, "u32list", str(tmp_path / "labels"), 91, split).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == list(enumerate(ids.tolist()))
    codes = RNG.integers(0, 256, (40, 3))
    (tmp_path / "codes").write_bytes(formats.format_codes(codes))
    got = binary.read(spark, "pqcodes", str(tmp_path / "codes"), 3, split).orderBy("vec_id").collect()
    assert [r["codes"] for r in got] == codes.tolist()
    with pytest.raises(ValueError):
        binary.read(spark, "u32list", str(tmp_path / "labels"), 90)
    with pytest.raises(ValueError):
        binary.read(spark, "pqcodes", str(tmp_path / "labels"))
    (tmp_path / "nothing").write_bytes(formats.format_u32_list(np.zeros(0)))
    assert binary.read(spark, "u32list", str(tmp_path / "nothing")).collect() == []


@pytest.mark.parametrize("split", [4, 20, 1 << 20])
def test_members(spark, tmp_path, split):
    sizes = [0, 3, 0, 0, 40, 1, 0, 5, 0]
    ids = RNG.integers(0, 1000, sum(sizes))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    data = formats.format_members(offsets, ids)
    (tmp_path / "m").write_bytes(data)
    want = [(c, i, int(ids[offsets[c] + i])) for c, n in enumerate(sizes) for i in range(n)]
    df = binary.read(spark, "vecmembers", str(tmp_path / "m"), 9, split)
    assert df.rdd.getNumPartitions() == -(-len(ids) // (split // 4))
    assert sorted(map(tuple, df.collect())) == sorted(want)
    binary.write_members(df.repartition(5), str(tmp_path / "again"), 9)
    assert (tmp_path / "again").read_bytes() == data
    with pytest.raises(ValueError):
        binary.write_members(df, str(tmp_path / "few"), 5)
    binary.write_members(df.limit(0), str(tmp_path / "empty"), 2)
    assert binary.read(spark, "vecmembers", str(tmp_path / "empty")).collect() == []
    for bad in (offsets[::-1], offsets + 1, np.append(offsets[:-1], 3)):
        (tmp_path / "bad").write_bytes(formats.format_members(bad, ids))
        with pytest.raises(ValueError):
            binary.read(spark, "vecmembers", str(tmp_path / "bad"))


def test_members_with_many_offsets(spark, tmp_path):
    """More offsets than one read holds, most lists empty."""
    n = 3 * binary.BATCH_BYTES // 8 // 2
    offsets = np.concatenate([np.zeros(n, np.int64), [2, 2, 3]])
    (tmp_path / "m").write_bytes(formats.format_members(offsets, np.array([9, 8, 7])))
    assert sorted(map(tuple, binary.read(spark, "vecmembers", str(tmp_path / "m"), None, 4).collect())) == [(n - 1, 0, 9), (n - 1, 1, 8), (n + 1, 0, 7)]
