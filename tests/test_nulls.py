"""Null series, scores, vectors and targets, empty batches, and vector files of other writers."""

import pytest
from pyspark.sql import functions as F

from textlab.operators import ensemble as EN
from textlab.operators import profile as P
from textlab.operators import sample as S
from textlab.operators import vectors as VE
from textlab.operators.prompts import fill_template
from textlab.sources import csv_io as IO
from textlab.worker import worker_object


def test_histograms_keep_a_null_series(spark):
    d = spark.createDataFrame([(None, 1), (None, 2), ("a", 3), ("a", 5)], "s string, x int")
    for h in (P.histogram_equal_width(d, "x", 2, "s"), P.histogram_int_edges(d, "x", range(10), "s")):
        got = {r["series"]: r["n"] for r in h.groupBy("series").agg(F.sum("n").alias("n")).collect()}
        assert got == {None: 2, "a": 2}


def test_null_scores_and_empty_batches(spark):
    d = spark.createDataFrame([(0.5, 1), (None, 1), (0.5, None)], "s double, t int")
    r = EN.bce_loss(d, "s", "t").first()
    assert abs(r["bce_prob"] - 0.693147) < 1e-5
    log = spark.createDataFrame([("r", 1, 1, 0, 0, 1.0), ("r", 1, 2, 4, 2, 1.0)],
                                "run string, epoch int, batch int, n int, correct int, loss double")
    r = EN.runlog_rollup(log).first()
    assert (r["accuracy"], r["mean_batch_acc"], r["last_batch_acc"]) == (0.5, 0.5, 0.5)


def test_null_targets(spark):
    d = spark.createDataFrame([(1, None), (2, 0), (2, 1), (2, 1)], "cluster int, target int")
    got = {r["cluster"]: r["purity"] for r in VE.cluster_purity(d).collect()}
    assert got[1] is None and abs(got[2] - 2 / 3) < 1e-9
    assert {r["target"]: r["weight"] for r in S.class_weights(d).collect()} == {0: 1.5, 1: 0.75}


def test_nearest_centroid_null_rows_and_blocks(spark, monkeypatch):
    p = spark.createDataFrame([(1, [0.0, 0.1]), (2, None), (3, [5.0, 5.0])], "id bigint, vec array<double>")
    c = spark.createDataFrame([(7, [0.0, 0.0]), (8, [5.0, 4.0])], "cluster int, cvec array<double>")
    want = {1: 7, 2: None, 3: 8}
    assert {r["id"]: r["cluster"] for r in VE.nearest_centroid(p, c).collect()} == want
    monkeypatch.setattr(VE, "MAX_CENTROID_VALUES", 1)
    assert {r["id"]: r["cluster"] for r in VE.nearest_centroid(p, c).collect()} == want


def test_vector_file_with_blanks_at_line_ends(spark, tmp_path):
    f = tmp_path / "v.vec"
    f.write_text("2 3\na 1 2 3 \nb 4 5 6 \n")
    assert {r["tok"]: r["vec"] for r in IO.read_word_vectors(spark, str(f), 3).collect()} == {"a": [1, 2, 3], "b": [4, 5, 6]}
    assert IO.read_word_vectors(spark, str(f)).count() == 2
    f.write_text("2 3\na 1 2 3\nb 4 5\n")
    with pytest.raises(Exception, match="wrong width"):
        IO.read_word_vectors(spark, str(f), 3).collect()


def test_templates_check_their_examples():
    with pytest.raises(ValueError):
        fill_template(2, [])
    with pytest.raises(ValueError):
        fill_template(10, [("x", 1)] * 9)
    assert "[example_tweet" not in fill_template(10, [("x", 1)] * 10)


def test_worker_object_is_made_once():
    made = []
    assert worker_object("k1", lambda: made.append(1) or "a") == worker_object("k1", lambda: made.append(1) or "b") == "a"
    assert made == [1]
