"""The corpus pipeline: documents -> quality -> line dedup -> near-duplicate
dedup -> mixing -> packed sequences. Each stage gets what the one before kept,
written as Parquet and read again.

Mixing writes its rows sorted by training position. Packing numbers sequences
of each length in the order of the files' part numbers and of the rows in them,
so the curriculum outlasts the write, whatever order Spark reads the files in.

Null and empty texts fail the quality rules. A document without an id is never a
near duplicate of another, loses lines after all others, and is mixed and packed
like them (its doc_id is null). Rows equal in id and text lose the same lines,
are near duplicates of themselves under one id and stay together; a null source
is a source of its own. Texts of any length are worked off whole. Further
columns, whatever their names, reach the mixing stage untouched. An empty table gives no sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from textlab.llm.lines import drop_lines
from textlab.llm.mixing import mix_rows
from textlab.llm.neardup import keep_one
from textlab.llm.packing import pack
from textlab.llm.quality import keep_good
from textlab.session import stage_table


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark, docs, sf_dir):
    """Documents that the quality rules accept."""
    return keep_good(docs, _table(spark, sf_dir, "labels"))


def line_dedup(spark, docs, sf_dir):
    """All documents, without lines that nearly repeat an earlier one's."""
    return drop_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """One document (the smallest id) of each group of near duplicates: five-word shingles, similarity 0.8."""
    return keep_one(docs, words=5, share=(80, 100))


def mixing(spark, docs, sf_dir):
    """Documents as often as the mix takes them, in training order."""
    return mix_rows(docs)


def packing(spark, docs, sf_dir):
    """Training sequences: one row per piece, with its ids."""
    return pack(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mixing", mixing),
          ("packing", packing)]

# a trained classifier, MinHash and a tokenizer cannot be said in SQL; tests/llm holds the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
