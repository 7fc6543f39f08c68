"""Findings of round 3: memory of a task bounded by its blocks, work that does not hang on one task."""

import numpy as np
import pyarrow as pa
import pytest

from textlab.operators import ann as AN
from textlab.operators import sweep as SW
from textlab.operators import vectors as VX


class Largest(np.ndarray):
    """Remembers the most numbers that any result of its arithmetic held."""

    most = 0

    def __array_ufunc__(self, ufunc, method, *inputs, out=None, **kw):
        plain = lambda a: a.view(np.ndarray) if isinstance(a, Largest) else a
        if out is not None:
            kw["out"] = tuple(plain(o) for o in out)
        got = getattr(ufunc, method)(*(plain(a) for a in inputs), **kw)
        Largest.most = max(Largest.most, getattr(got, "size", 0))
        return got.view(Largest) if isinstance(got, np.ndarray) else got


def test_nearest_centroid_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x, c = rng.normal(size=(70, 3)), rng.normal(size=(9, 3))
    x[10:20] = (c[2] + c[5]) / 2       # as far from one as from the other
    c[7] = c[4]                        # equal centres
    points = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(99, None)], "id long, vec array<double>").coalesce(1)
    centres = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(c)], "cluster int, cvec array<double>")
    want = {r["id"]: r["cluster"] for r in VX.nearest_centroid(points, centres).collect()}
    d = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert all(want[i] == d[i].argmin() for i in [*range(10), *range(20, 70)]) and want[99] is None
    monkeypatch.setattr(VX, "DISTANCES", 30)   # three rows at a time
    assert {r["id"]: r["cluster"] for r in VX.nearest_centroid(points, centres).collect()} == want


def test_ann_holds_no_more_than_a_block(monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8))
    model = AN.IvfPq(rng.normal(size=(20, 8)), rng.normal(size=(4, 16, 2)))
    want = model.assign(x, 3), model.encode(x), model.tables(x), AN.learn_words(x[:, :2], 8)
    monkeypatch.setattr(AN, "HELD", 200)
    Largest.most = 0
    own = AN.IvfPq(model.centroids, model.words)
    got = own.assign(x.view(Largest), 3), own.encode(x), own.tables(x), AN.learn_words(x[:, :2].view(Largest), 8)
    assert (want[0] == got[0]).all() and (want[1] == got[1]).all() and (want[2] == got[2]).all() and np.allclose(want[3], got[3])
    assert Largest.most <= 400 * 8  # no table of all rows by all centroids (400 * 20), words (400 * 8 * 2)


def test_slices():
    assert [(s.start, s.stop) for s in AN.slices(5, AN.HELD // 2)] == [(0, 2), (2, 4), (4, 5)]
    assert AN.slices(0, 3) == [] and len(AN.slices(3, 10 * AN.HELD)) == 3


def test_sums_by_group():
    group, x = np.array([4, 1, 4, 1, 9]), np.arange(10.0).reshape(5, 2)
    used, n, total = SW.sums_by(group, x)
    assert used.tolist() == [1, 4, 9] and n.tolist() == [2, 2, 1] and total.tolist() == [[8, 10], [4, 6], [8, 9]]
    assert SW.sums_by(np.zeros(0, int), np.zeros((0, 2)))[2].shape == (0, 2)
    rows = pa.table({"task": [1, 0, 0], "which": [2, 2, 2], "cluster": [5, 5, 3], "n": [1, 2, 4], "moved": [1, 0, 1],
                     "total": [[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]]}, schema=pa.schema(list(SW.KINDS.items())))
    got = SW._add_up(rows).to_pylist()
    assert [(r["cluster"], r["n"], r["moved"], r["total"]) for r in got] == [(3, 4, 1, [5, 6]), (5, 3, 1, [4, 6])]


def test_nearest_two_with_many_ties():
    rng = np.random.default_rng(7)
    c = np.repeat(rng.integers(-3, 4, size=(12, 4)).astype(float), 3, axis=0)  # every centre three times
    x = rng.integers(-3, 4, size=(700, 4)).astype(float)
    best, first, second = SW.nearest_two(x, c)
    d = ((x[:, None] - c[None]) ** 2).sum(-1)
    assert (best == d.argmin(axis=1)).all() and np.allclose(first, np.sqrt(d.min(axis=1))) and (second <= first + 1e-9).all()


def test_sweep_deals_out_one_file(spark, tmp_path, monkeypatch):
    """Vectors in one row group are not one task's."""
    rng = np.random.default_rng(9)
    at = str(tmp_path / "one")
    spark.createDataFrame([(i, [float(v) for v in r], i % 2) for i, r in enumerate(rng.normal(size=(200, 3)))],
                          "id long, vec array<double>, target int").coalesce(1).write.parquet(at)
    seen = []
    stage = SW.stage_table
    monkeypatch.setattr(SW, "stage_table", lambda df, what: (seen.append(df.rdd.getNumPartitions()), stage(df, what))[1])
    assigned, _, _ = SW.lloyd_sweep(spark.read.parquet(at), [3])
    assert seen == [spark.sparkContext.defaultParallelism] and assigned.count() == 200
