"""What groups over vectors leave on disk: compressed bits, and members whose equal scores lie in a row."""

import pickle

import numpy as np
import pytest
from pyspark import SparkContext

from entwine.operators import vector_groups
from entwine.operators.vector_groups import VectorEdges, walk


@pytest.mark.parametrize("without_seed", [False, True])
def test_group_bits_travel_compressed(spark, monkeypatch, without_seed):
    x = np.random.RandomState(5).normal(size=(1500, 6))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    sizes, real = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, v: (sizes.append(len(pickle.dumps(v))), real(self, v))[1])
    got = walk(rows.filter("id % 2 = 0").select("id"), VectorEdges(rows, 0.9), [0.9] * 3, without_seed).toPandas()
    assert sizes[-1] < 2 * 1500 * 750 // 8 * 2 // 3  # bits of two hops
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 12)
    near = (cos >= 0.9) & ~np.eye(1500, dtype=bool)
    for seed in (0, 700):
        want, last, seen = {}, {seed}, set() if without_seed else {seed}
        for hop in (1, 2, 3):
            reached = {int(j) for i in last for j in np.flatnonzero(near[i])} - seen
            want |= {j: (hop, max(cos[i, j] for i in last if near[i, j])) for j in reached if j != seed}
            last, seen = reached, seen | reached
        mine = got[got.group_id == seed]
        assert len(mine) == len(want)
        assert {j: (h, s) for j, s, h in zip(mine.id, mine.score, mine.hop_distance)} == {j: (h, pytest.approx(s, abs=1e-9)) for j, (h, s) in want.items()}
    same = (got.id.diff() == 0) & (got.hop_distance.diff() == 0)
    assert (got.score.diff()[same] >= 0).all()


@pytest.mark.parametrize("least_bytes", [None, 1])
def test_group_vectors_and_bits_leave_no_copy_with_each_executor(spark, monkeypatch, least_bytes):
    if least_bytes:  # bits of so few rows are small
        monkeypatch.setattr(vector_groups, "PIECES", range(least_bytes, 48 << 20))
    x = np.random.RandomState(3).normal(size=(2400, 64))
    x[:, :4] *= 4
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, vector array<double>")
    sizes, real = [], SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, v: (sizes.append(len(pickle.dumps(v))), real(self, v))[1])
    got = walk(rows.filter("id % 40 = 0").select("id"), VectorEdges(rows, 0.75), [0.75] * 3).toPandas()
    assert max([0, *sizes]) < (1000 if least_bytes else 1 << 20)  # the vectors have 1.2 MB
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cos = np.round(unit @ unit.T, 12)
    near = (cos >= 0.75) & ~np.eye(len(x), dtype=bool)
    for seed in range(0, 2400, 40):
        want, last, seen = {}, {seed}, {seed}
        for hop in (1, 2, 3):
            reached = {int(j) for i in last for j in np.flatnonzero(near[i])} - seen
            want |= {j: (hop, pytest.approx(max(cos[i, j] for i in last if near[i, j]), abs=1e-9)) for j in reached}
            last, seen = reached, seen | reached
        mine = got[got.group_id == seed]
        assert len(mine) == len(want)
        assert {j: (h, s) for j, s, h in zip(mine.id, mine.score, mine.hop_distance)} == want
    assert got.hop_distance.nunique() == 3
