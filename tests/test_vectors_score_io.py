"""Vector labelling against numpy brute force, k-means invariants, model
scoring against numpy, source/sink round trips and a streaming run."""

import os
import tempfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from textlab.operators import score as SC
from textlab.operators import vectors as VX
from textlab.sources import csv_io as IO
from textlab.streaming import features as ST


@pytest.fixture(scope="module")
def pts(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 8)).round(1)      # rounding makes exact distance ties
    x[10] = x[11] = x[12]                       # exact duplicates
    y = (x[:, 0] > 0).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(y[i]), i % 4 == 0) for i in range(300)]
    return spark.createDataFrame(rows, "id LONG, vec ARRAY<DOUBLE>, target INT, is_query BOOLEAN"), x, y


def _brute_knn(x, y, qidx, bidx, k):
    out = {}
    for q in qidx:
        d2 = ((x[bidx] - x[q]) ** 2).sum(1)
        order = np.lexsort((bidx, d2))[:k]
        votes = np.bincount(y[bidx][order], minlength=2)
        out[q] = int(np.argmax(votes))  # argmax takes the smaller label on ties
    return out


@pytest.mark.parametrize("block", [7, 2048])
def test_knn_matches_brute_force(spark, pts, block):
    df, x, y = pts
    qidx = [i for i in range(300) if i % 4 == 0]
    bidx = np.array([i for i in range(300) if i % 4 != 0])
    got = {r.id: r.predicted for r in VX.knn_classify(df.where("is_query"), df.where("not is_query"), 5,
                                                        block_rows=block).collect()}
    assert got == _brute_knn(x, y, qidx, bidx, 5)
    nb = VX.knn_neighbours(df.where("is_query"), df.where("not is_query"), 3, block_rows=block)
    q0 = sorted((r["rank"], r.bid) for r in nb.where("qid = 12").collect())
    d2 = ((x[bidx] - x[12]) ** 2).sum(1)
    assert [b for _, b in q0] == list(bidx[np.lexsort((bidx, d2))[:3]])


def test_knn_sweep_consistent_with_single_k(spark, pts):
    df, x, y = pts
    q, b = df.where("is_query"), df.where("not is_query")
    sweep = {(r.id, r.k): r.predicted for r in VX.knn_k_sweep(q, b, (1, 5), block_rows=50).collect()}
    single = {r.id: r.predicted for r in VX.knn_classify(q, b, 5, block_rows=50).collect()}
    assert {i: p for (i, k), p in sweep.items() if k == 5} == single


def test_nearest_centroid_and_purity(spark, pts):
    df, x, y = pts
    cidx = [0, 50, 100, 150]
    cen = spark.createDataFrame([(j, [float(v) for v in x[c]]) for j, c in enumerate(cidx)], "cluster INT, cvec ARRAY<DOUBLE>")
    got = {r.id: r.cluster for r in VX.nearest_centroid(df, cen).collect()}
    c = x[cidx]
    want = {i: int(np.lexsort((np.arange(4), ((c - x[i]) ** 2).sum(1)))[0]) for i in range(300)}
    assert got == want
    asg = VX.nearest_centroid(df, cen).join(df.select("id", "target"), "id")
    pur = {r.cluster: (r.n0, r.n1, r.label) for r in VX.cluster_purity(asg).collect()}
    for cl in pur:
        members = [i for i in range(300) if want[i] == cl]
        n1 = int(y[members].sum())
        assert pur[cl] == (len(members) - n1, n1, 0 if len(members) - n1 >= n1 else 1)


def test_kmeans_invariants(spark, pts):
    df, x, _ = pts
    model, cen, asg = VX.kmeans_fit(df, 4, seed=1)
    assert cen.count() == 4
    a = {r.id: r.cluster for r in asg.collect()}
    assert len(a) == 300
    c = np.array([r.cvec for r in cen.orderBy("cluster").collect()])
    d = ((x[:, None, :] - c[None, :, :]) ** 2).sum(-1)
    assert all(d[i, a[i]] <= d[i].min() + 1e-9 for i in range(300))  # each row at its nearest centre


def test_cluster_count_sweep_rows(spark, pts):
    df, _, _ = pts
    out = VX.cluster_count_sweep(df, 6, max_iter=5).collect()
    assert [r.num_clusters for r in out] == list(range(2, 18, 1))
    assert sum(r.is_best for r in out) == 1


def test_mlp_score_matches_numpy(spark, pts):
    df, x, _ = pts
    layers = SC.mlp_init([8, 16, 4, 1], seed=2)
    got = {r.id: r.score for r in SC.mlp_score(df, layers).collect()}
    want = SC.mlp_forward(x, layers)
    assert np.allclose([got[i] for i in range(300)], want, rtol=1e-12)


def test_batch_score_batches(spark):
    d = spark.createDataFrame([(i, f"w{i % 3} x") for i in range(100)], "id LONG, text STRING")

    def predict(model, pdf):
        return pd.DataFrame({"id": pdf["id"], "n": len(pdf)})

    out = SC.batch_score(d, ["id", "text"], lambda: object(), predict, "id long, n long", batch_size=8)
    got = [r.n for r in out.collect()]
    assert len(got) == 100 and max(got) <= 8


def test_seed_sweep_ensemble_runs(spark, pts):
    df, _, _ = pts
    out = SC.seed_sweep_ensemble(df.where("not is_query"), df.where("is_query"), n_runs=2, max_iter=5)
    assert out.count() == 75 and out.where("mean_score < 0 or mean_score > 1").count() == 0
    zero = SC.seed_sweep_ensemble(df.where("not is_query"), df.where("is_query"), n_runs=0)
    assert zero.count() == 75 and zero.where("target <> 0").count() == 0


def test_csv_round_trip_hard_texts(spark):
    rows = [(1, "k,1", None, 'say "hi", ok', 1), (2, None, "loc", "line1\nline2\r\nline3", 0),
            (3, "None", "x", "  padded  ", 1), (4, "b", "y", "back\\slash ,\"", 0)]
    df = spark.createDataFrame(rows, IO.LABELLED_SCHEMA)
    path = os.path.join(tempfile.mkdtemp(), "lab")
    IO.write_csv(df.repartition(3), path)
    back = IO.read_csv(spark, path, IO.LABELLED_SCHEMA)
    assert sorted(map(tuple, back.collect())) == sorted(rows)
    assert IO.read_labelled(spark, path).columns == ["text", "target"]


def test_prediction_runs_listed_twice(spark):
    root = tempfile.mkdtemp()
    for run in ("m1", "m2"):
        IO.write_predictions(spark.createDataFrame([(1, 1), (2, 0)], IO.PREDICTION_SCHEMA), os.path.join(root, run))
    paths = [os.path.join(root, "m1"), os.path.join(root, "m2"), os.path.join(root, "m2")]
    got = IO.read_prediction_runs(spark, paths).groupBy("run").count().collect()
    assert {r.run: r["count"] for r in got} == {"m1": 2, "m2": 4}


def test_word_vectors_text_format(spark):
    wv = spark.createDataFrame([("a", [0.1, -2.5]), ("b", [3.0, 1e-7])], "tok STRING, vec ARRAY<FLOAT>")
    path = os.path.join(tempfile.mkdtemp(), "vec")
    IO.write_word_vectors(wv, path)
    back = {r.tok: r.vec for r in IO.read_word_vectors(spark, path).collect()}
    assert back == {r.tok: r.vec for r in wv.collect()}
    header = [r.value for r in spark.read.text(path).collect() if len(r.value.split(" ")) == 2]
    assert header == ["2 2"]


def test_streaming_errors_and_counts(spark):
    src = tempfile.mkdtemp()
    preds = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "id LONG, target INT")
    preds.write.mode("overwrite").parquet(os.path.join(src, "batch0"))
    truth = spark.createDataFrame([(1, "a", "x", "Hi #x", 1), (2, "a", None, "OK GO http://x", 1), (3, "b", "y", "z", 0)],
                                  "id LONG, keyword STRING, location STRING, text STRING, target INT")
    stream = ST.read_prediction_stream(spark, os.path.join(src, "batch0"), "id LONG, target INT")
    m = ST.errors_with_features(stream, truth)
    out = os.path.join(tempfile.mkdtemp(), "out")
    q = ST.start_to_parquet(m, out)
    q.awaitTermination(120)
    res = {r.id: (r.is_error, r.hashtag_count, r.contains_link, r.caps_word_count) for r in spark.read.parquet(out).collect()}
    assert res == {1: (False, 1, 0, 0), 2: (True, 0, 1, 2), 3: (True, 0, 0, 0)}
    counts = ST.running_error_counts(ST.errors_with_features(
        ST.read_prediction_stream(spark, os.path.join(src, "batch0"), "id LONG, target INT"), truth), "keyword")
    cq = counts.writeStream.format("memory").queryName("err_counts").outputMode("complete").start()
    cq.processAllAvailable()
    got = {r.keyword: (r.n_err, r.n) for r in spark.sql("SELECT * FROM err_counts").collect()}
    cq.stop()
    assert got == {"a": (1, 2), "b": (1, 1)}
