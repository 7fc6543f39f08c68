"""Binary word vectors: round trips, splits at every byte, pushdown."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.session import scratch_path
from textlab.sources import word2vec as W

TOKENS = ["the", "a", "é日本", "x" * 300, "</s>", "0", "12.5", "don't", "a", "🎉", "tab\there"]


def make(path, rows, newline=True, head=None):
    dim = len(rows[0][1]) if rows else 0
    with open(path, "wb") as f:
        f.write((head or f"{len(rows)} {dim}\n").encode())
        for tok, vec in rows:
            f.write(tok.encode() + b" " + np.asarray(vec, "<f4").tobytes() + b"\n" * newline)
    return str(path)


def rows_of(n, dim, seed=0):
    rng = np.random.default_rng(seed)
    return [(f"{TOKENS[i % 10]}{i}", rng.normal(size=dim).astype(np.float32)) for i in range(n)]


def key(rows):
    return sorted((t, tuple(float(x) for x in v)) for t, v in rows)


@pytest.mark.parametrize("newline", [True, False])
@pytest.mark.parametrize("split", [0, 1000, 4097])
def test_one_file_in_many_ranges(tmp_path, newline, split):
    """Reader alone: all ranges together give each record once."""
    rows = rows_of(400, 25)
    reader = W.WordVectorReader(make(tmp_path / "v.bin", rows, newline), split, True)
    parts, got = reader.partitions(), []
    assert len(parts) == 1 if not split else len(parts) > 8
    for p in parts:
        for b in reader.read(p):
            got += zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
    assert key(got) == key(rows) and [t for t, _ in got] == [t for t, _ in rows]


def test_every_byte_as_a_cut(tmp_path):
    rows = rows_of(40, 8, 3)
    path = make(tmp_path / "v.bin", rows)
    reader = W.WordVectorReader(path, 0, True)
    whole = reader.partitions()[0]
    for cut in range(whole.first + 1, whole.size, 3):
        got = []
        for low, high in ((whole.first, cut), (cut, whole.size)):
            for b in reader.read(W.Range(path, whole.size, whole.first, 8, low, high)):
                got += b.column(0).to_pylist()
        assert got == [t for t, _ in rows], cut


def test_vectors_that_read_as_text_are_an_error_not_wrong_rows(tmp_path):
    """Floats whose bytes are letters and spaces: either right, or refused; whole files always work."""
    spoof = np.frombuffer(b"ab cd ef gh ij k", "<f4")
    rows = [(f"w{i}", spoof) for i in range(300)]
    path = make(tmp_path / "v.bin", rows, False)
    whole = W.WordVectorReader(path, 0, False)
    assert [t for b in whole.read(whole.partitions()[0]) for t in b.column(0).to_pylist()] == [t for t, _ in rows]
    reader, got = W.WordVectorReader(path, 500, False), []
    try:
        for p in reader.partitions():
            for b in reader.read(p):
                got += b.column(0).to_pylist()
    except ValueError:
        return
    assert got == [t for t, _ in rows]


def test_spark_reads_one_file_with_many_tasks(spark, tmp_path):
    rows = rows_of(3000, 50, 1)
    path = make(tmp_path / "v.bin", rows)
    df = W.read_binary_vectors(spark, path, split_bytes=50_000)
    assert df.rdd.getNumPartitions() >= 12
    assert key((r["tok"], r["vec"]) for r in df.collect()) == key(rows)
    slim = W.read_binary_vectors(spark, path, vectors=False, split_bytes=50_000)
    assert slim.columns == ["tok"] and slim.count() == 3000
    some = df.where(F.col("tok").isin("the0", "a1", "none")).where("size(vec) = 50")
    assert sorted(r["tok"] for r in some.collect()) == ["a1", "the0"]
    assert df.where("tok = 'the0'").count() == 1 and df.where("tok like 'the%'").count() == 300


def test_filters_are_pushed():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In
    reader = W.WordVectorReader("x", 0, True)
    left = [EqualTo(("tok",), "a"), In(("tok",), ("a", "b")), GreaterThan(("tok",), "a"), EqualTo(("vec",), "a")]
    assert list(reader.pushFilters(left)) == left[2:] and reader.tokens == {"a"}


def test_round_trip(spark):
    path = scratch_path(spark, "w2v")
    rows = [(t, [float(i), -0.5, 1e-9]) for i, t in enumerate(TOKENS)] + [(None, [1.0, 2.0, 3.0]), ("gone", None), ("", [1.0, 1.0, 1.0])]
    rows = [r for r in rows if r[0] != "tab\there"]
    df = spark.createDataFrame(rows, "tok string, vec array<double>").repartition(3)
    W.write_binary_vectors(df, path)
    want = key((t, np.float32(v)) for t, v in rows if t and v)
    assert key((r["tok"], r["vec"]) for r in W.read_binary_vectors(spark, path).collect()) == want
    W.write_binary_vectors(df, path)  # overwrites
    assert key((r["tok"], r["vec"]) for r in W.read_binary_vectors(spark, path, split_bytes=1).collect()) == want
    W.write_binary_vectors(df.limit(0), path)
    assert W.read_binary_vectors(spark, path).collect() == []


def test_refused(spark, tmp_path):
    bad = tmp_path / "bad.bin"
    bad.write_bytes(b"no header here, only text that goes on and on and on and on and on")
    with pytest.raises(Exception, match="word2vec"):
        W.read_binary_vectors(spark, str(bad)).collect()
    for rows in ([("a b", [1.0])], [("a", [1.0]), ("b", [1.0, 2.0])]):
        with pytest.raises(Exception, match="cannot be written"):
            W.write_binary_vectors(spark.createDataFrame(rows, W.SCHEMA).coalesce(1), str(tmp_path / "out"))
