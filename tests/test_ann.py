"""Approximate neighbours: recall against brute force, blocks, edge cases."""

import numpy as np
import pytest

from textlab.operators import ann as A
from textlab.plans.fixtures import view


def exact(ids, x, qids, k):
    out = {}
    for q in qids:
        d2 = ((x - x[ids.index(q)]) ** 2).sum(1)
        order = sorted(range(len(ids)), key=lambda i: (d2[i], ids[i]))[:k]
        out[q] = [(ids[i], d2[i]) for i in order]
    return out


def recall(rows, want, k):
    got = {}
    for r in rows:
        got.setdefault(r["qid"], set()).add(r["bid"])
    return sum(len(got.get(q, set()) & {i for i, _ in w}) for q, w in want.items()) / (k * len(want))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_given_vectors(spark, sf):
    pts = view(spark, f"/root/testdata/{sf}", "points")
    rows = pts.select("id", "vec").collect()
    ids, x = [r["id"] for r in rows], np.array([r["vec"] for r in rows], np.float64)
    got = A.ann_neighbours(pts.where("id % 20 = 0"), pts, 5).collect()
    want = exact(ids, x, [i for i in ids if i % 20 == 0], 5)
    assert recall(got, want, 5) >= 0.9
    for r in got:  # distances are exact, ranks in their order
        assert abs(r["d2"] - ((x[ids.index(r["bid"])] - x[ids.index(r["qid"])]) ** 2).sum()) < 1e-9
    assert all(sorted(r["rank"] for r in got if r["qid"] == q) == [1, 2, 3, 4, 5] for q in list(want)[:5])


def test_many_lists_blocks_and_a_hot_list(spark):
    """Lists cut into blocks, a third of all rows at one spot, a sample smaller than the table."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 12)) * 4
    x = centres[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 12))
    x[:1000] = centres[0] + rng.normal(size=(1000, 12)) * 0.3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<float>").repartition(4)
    x = x.astype(np.float32).astype(np.float64)
    options = dict(parts=5, probes=6, list_rows=100, block_rows=50, sample_rows=1500, rerank=60)
    got = A.ann_neighbours(df.where("id % 20 = 0"), df, 5, **options).collect()
    want = exact(list(range(3000)), x, list(range(0, 3000, 20)), 5)
    assert recall(got, want, 5) >= 0.9
    again = A.ann_neighbours(df.where("id % 20 = 0"), df, 5, **dict(options, block_rows=4096)).collect()
    assert abs(recall(again, want, 5) - recall(got, want, 5)) < 0.03


def test_all_lists_and_candidates_are_exact(spark):
    """With every list probed and every row re-ranked the result is the exact one, ties by id."""
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, size=(200, 4)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    got = A.ann_neighbours(df.where("id < 20"), df, 7, parts=2, list_rows=20, probes=1000, rerank=1000, block_rows=32).collect()
    want = exact(list(range(200)), x, list(range(20)), 7)
    for q, w in want.items():
        assert [r["bid"] for r in sorted((r for r in got if r["qid"] == q), key=lambda r: r["rank"])] == [i for i, _ in w]


def test_vote(spark):
    pts = view(spark, "/root/testdata/sf0.001", "points")
    got = A.ann_classify(pts.where("is_query"), pts.where("not is_query"), (2, 5), probes=1000, rerank=1000).collect()
    from textlab.operators import vectors as VX
    want = VX.knn_k_sweep(pts.where("is_query"), pts.where("not is_query"), (2, 5)).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in want)


def test_edges(spark):
    schema = "id string, vec array<double>, target int, bid int, list int"
    rows = [("a", [0.0, 0.0], 1, 0, 0), ("b", None, 0, 0, 0), ("c", [1.0, 0.0], None, 0, 0), ("d", [0.0, 3.0], 1, 0, 0)]
    df = spark.createDataFrame(rows, schema)
    got = A.ann_neighbours(df, df, 5, parts=2)
    assert sorted((r["qid"], r["bid"], r["rank"]) for r in got.collect()) == [
        ("a", "a", 1), ("a", "c", 2), ("a", "d", 3), ("c", "a", 2), ("c", "c", 1), ("c", "d", 3), ("d", "a", 2), ("d", "c", 3), ("d", "d", 1)]
    assert A.ann_neighbours(df, df.limit(0)).collect() == [] and A.ann_neighbours(df.limit(0), df, parts=2).collect() == []


def test_learn_words_covers_few_rows():
    w = A.learn_words(np.array([[0.0], [5.0]]), 4)
    assert {0.0, 5.0} <= set(w[:, 0].tolist())
