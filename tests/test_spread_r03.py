"""Findings of round 3: costly work on all cores, inputs computed once."""

import numpy as np
import pyarrow as pa

from textlab.operators import recurrent as R
from textlab.operators import subword as W
from textlab.sources import csv_io as IO


def test_recurrent_rows_of_one_partition_are_dealt_out(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "idx int, vec array<double>")
    rows = spark.createDataFrame([(i, [1 + i % 4, 0]) for i in range(40)], "id long, input_ids array<int>").coalesce(1)
    out = R.recurrent_score(rows, vectors, R.recurrent_init("lstm", 2, 3))
    assert out.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism and out.count() == 40


def test_rows_of_a_batch_end_apart():
    rng = np.random.default_rng(1)
    model, x, lengths = R.recurrent_init("gru", 4, 3, 2), rng.normal(size=(5, 6, 4)), np.array([2, 0, 6, 1, 6])
    whole = R.scan(model, x, lengths)
    assert all(np.allclose(whole[i], R.scan(model, x[i: i + 1, :n], lengths[i: i + 1])[0], atol=1e-12) for i, n in enumerate(lengths))


def test_written_vectors_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(len(b))
            yield b
    df = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "tok string, vec array<float>").mapInPandas(count, "tok string, vec array<float>")
    IO.write_word_vectors(df, str(tmp_path / "v"))
    assert seen.value == 2
    assert {r["value"] for r in spark.read.text(str(tmp_path / "v")).collect()} == {"2 2", "a 1.0 2.0", "b 3.0 4.0"}
    IO.write_word_vectors(df.where("tok = 'z'"), str(tmp_path / "none"))
    assert {r["tok"] for r in IO.read_word_vectors(spark, str(tmp_path / "v"), 2).collect()} == {"a", "b"}


def test_words_with_a_pair():
    words = [["a", "##b"], ["##b", "a"], [], ["a"], ["##b", "c"], ["c", "c", "c"], ["x", "a", "##b"]]
    table = pa.array(words, pa.list_(pa.string()))
    hit = W.with_pair(table, {("a", "##b"): "ab", ("c", "c"): "cc"})
    assert hit.tolist() == [True, False, False, False, False, True, True]
    assert W.with_pair(table.slice(2, 2), {("a", "##b"): "ab"}).tolist() == [False, False]
    assert W.with_pair(table.slice(5), {("a", "##b"): "ab"}).tolist() == [False, True]
