"""Memory of the Python passes: how large their batches are."""

import random

import pytest
from pyspark.sql import functions as F

from textlab.llm import packing
from textlab.session import BATCH_BYTES, small_batches


def test_packing_reads_small_batches(spark, tmp_path, monkeypatch):
    """Long texts reach a worker a few at a time, with the same pieces."""
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices(["alpha", "beta", "gamma"], k=8000))) for i in range(300)]
    spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    table = spark.read.parquet(f"{tmp_path}/docs")
    plain, most = packing._cut_batches, 2 * BATCH_BYTES

    def watched(path, with_ids):
        run = plain(path, with_ids)

        def of(batches):
            def bounded():
                for pdf in batches:
                    if pdf["text"].str.len().sum() > most:
                        raise ValueError("a large batch")
                    yield pdf
            yield from run(bounded())
        return of

    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    monkeypatch.setattr(packing, "_cut_batches", watched)
    got = packing.pack(table, with_ids=False).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(got) == 300 and all(r["n"] == r["all"] for r in got)
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_small_batches_are_undone_after_an_error(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    with pytest.raises(ValueError), small_batches(spark):
        assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(BATCH_BYTES)
        raise ValueError
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
