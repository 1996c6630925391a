"""Matching by cutoffs, against the serial loop."""

import random

import numpy as np
import pytest

from vecloom.operators import matching


def serial(rows, capacity):
    room, out = list(capacity), {}
    for vec_id, _, wishes in sorted(rows, key=lambda r: (r[1], r[0])):
        c = next((c for c in wishes if room[c] > 0), None)
        if c is not None:
            room[c] -= 1
        out[vec_id] = c
    return out


@pytest.mark.parametrize(("ranges", "turns", "hot"), [(1024, 10**18, 0.0), (8, 50, 0.5), (1, 10, 0.9), (64, 1, 0.3)])
def test_matching_is_serial(spark, tmp_path, ranges, turns, hot):
    """Also with equal turns, a cluster that most want first, clusters without room, and vectors without candidates."""
    rng = random.Random(ranges)
    rows = []
    for v in range(600):
        wishes = rng.sample(range(12), rng.randint(0, 4))
        if rng.random() < hot and 3 not in wishes:
            wishes = [3, *wishes]
        rows.append((v - 100, rng.randint(-turns, turns), wishes))
    capacity = np.array([rng.choice([0, 5, 30, 60]) for _ in range(12)])
    df = spark.createDataFrame(rows, "vec_id long, turn long, c array<long>").repartition(5)
    df.write.parquet(str(tmp_path / "w"))
    wishes = spark.read.parquet(str(tmp_path / "w"))
    got = {r["vec_id"]: r["cluster_id"] for r in matching.chosen(wishes, matching.match(wishes, capacity, ranges)).collect()}
    assert got == serial(rows, capacity)


def test_matching_of_none(spark):
    none = spark.createDataFrame([], "vec_id long, turn long, c array<long>")
    assert matching.chosen(none, matching.match(none, np.array([1, 2]))).collect() == []
