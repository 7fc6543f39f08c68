"""Findings of round 4: time and what a task holds."""

import tracemalloc

import numpy as np
import pytest

from textlab.operators import recurrent as R


@pytest.mark.parametrize("kind", ["rnn", "gru", "lstm"])
def test_scan_holds_no_gates_of_all_steps(kind):
    """One product a step: the gates of a step are held, not those of all steps, and the top layer keeps no states but the last."""
    rng = np.random.default_rng(2)
    hidden, rows, steps = 24, 40, 50
    model = R.recurrent_init(kind, 4, hidden, 1)
    x, lengths = rng.normal(size=(rows, steps, 4)), rng.integers(0, steps + 1, rows)
    want = R.scan(model, x, lengths)
    tracemalloc.start()
    got = R.scan(model, x, lengths, R.packed(model))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(want, got)
    assert most < rows * steps * R.GATES[kind] * hidden * 8


def test_nearest_two_holds_one_table_in_single_precision():
    from textlab.operators import sweep as SW
    rng = np.random.default_rng(3)
    x, c = rng.normal(size=(700, 8)), rng.normal(size=(900, 8))
    d = np.sqrt(((x[:, None] - c[None]) ** 2).sum(-1))
    tracemalloc.start()
    best, first, second = SW.nearest_two(x, c)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < SW.ROWS_AT_A_TIME * len(c) * 8
    assert (best == d.argmin(axis=1)).all() and np.allclose(first, d.min(axis=1))
    assert (second <= np.sort(d, axis=1)[:, 1]).all() and np.allclose(second, np.sort(d, axis=1)[:, 1], atol=1e-3)


@pytest.mark.parametrize("shift,size", [(0.0, 1e-30), (0.0, 1e25), (1e7, 1.0), (-3e5, 0.01)])
def test_nearest_two_far_from_zero_and_of_any_size(shift, size):
    """Single precision finds the candidates only: the nearest is that of double precision, the first of equals."""
    from textlab.operators import sweep as SW
    rng = np.random.default_rng(4)
    c = shift + size * rng.normal(size=(60, 5))
    c[41] = c[7]
    x = np.concatenate([shift + size * rng.normal(size=(200, 5)), c, (c[:20] + c[20:40]) / 2, c[:1] * 0 + shift])
    d = ((x[:, None] - c[None]) ** 2).sum(-1)
    best, first, second = SW.nearest_two(x, c)
    assert (best == d.argmin(axis=1)).all() and np.array_equal(first, np.sqrt(d.min(axis=1)))
    assert (second <= np.sqrt(np.sort(d, axis=1)[:, 1]) * (1 + 1e-9)).all()


@pytest.mark.parametrize("kind", ["float", "double"])
def test_sweep_carries_bytes(spark, monkeypatch, kind):
    """The rows that a pass writes have no arrays of numbers; a vector keeps its kind, a null target stays null."""
    from textlab.operators import sweep as SW
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(f"k{i}", [float(v) for v in r], i % 2 if i % 7 else None) for i, r in enumerate(rng.normal(size=(90, 3)))],
                               f"id string, vec array<{kind}>, target int")
    made, path = [], SW.scratch_path
    monkeypatch.setattr(SW, "drop_path", lambda *_: None)
    monkeypatch.setattr(SW, "scratch_path", lambda s, what: (made.append(path(s, what)), made[-1])[1])
    assigned, centres, passes = SW.lloyd_sweep(df, [2, 5], seed=2)
    x = np.array([r["vec"] for r in df.collect()])
    rows = {r["id"]: r for r in assigned.collect()}
    assert len(rows) == 90 and rows["k7"]["target"] is None and rows["k8"]["target"] == 0
    for j, c in enumerate(centres):
        assert [rows[f"k{i}"]["a"][j] for i in range(90)] == ((x[:, None] - c[None]) ** 2).sum(-1).argmin(axis=1).tolist()
    types = dict(spark.read.parquet(made[-1]).dtypes)
    assert not any(t.startswith("array") for t in types.values()), types
    assert {len(r["x"]) for r in spark.read.parquet(made[-1]).where("x is not null").collect()} == {3 * (4 if kind == "float" else 8)}


def test_others_drift():
    from textlab.operators import sweep as SW
    assert SW.others_drift(np.array([1.0, 5.0, 2.0])).tolist() == [5, 2, 5]
    assert SW.others_drift(np.array([4.0])).tolist() == [0] and SW.others_drift(np.array([3.0, 3.0])).tolist() == [3, 3]


def test_a_fitted_model_is_sent_to_tasks_after_an_observation(spark):
    """An observation makes the session one that cannot be serialized; a model's training summary holds the session."""
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    from textlab.operators import score as SC
    seen = Observation()
    assert spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count() == 3 and seen.get == {"n": 3}
    df = spark.createDataFrame([(i, [float(i % 2), 1.0], i % 2) for i in range(40)], "id long, vec array<double>, target int")
    scored = SC.logistic_fit(5)(df, 0, "")(df, "id").collect()
    assert all((r["score"] > 0.5) == (r["id"] % 2 == 1) for r in scored)
