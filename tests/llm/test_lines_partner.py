"""Disk of the line dedup: what leaves early."""

import random

import pytest
from pyspark.sql import functions as F

from textlab.llm import lines as L


def test_lines_without_a_partner_leave_before_the_turns(spark, monkeypatch):
    """Lines of common buckets whose signatures are like no other's reach neither the turns nor the table of texts."""
    rng = random.Random(9)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=n))
    passage = letters(100)
    lines = [letters(100) + passage for _ in range(120)]  # similar to one another at some 0.33
    lines += [lines[5][:-1] + "?", lines[60][:-1] + "!"]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    made, plain = {}, L.stage_table

    def staged(df, what):
        out = plain(df, what)
        if "k" in out.columns:
            made.setdefault(what, []).append(out.select("k").distinct().count())
        return out

    monkeypatch.setattr(L, "stage_table", staged)
    joined = {r["node"]: r["component"] for r in L.line_components(docs, L.BROADCAST_KEYS).collect()}
    key = dict(enumerate(r["k"] for r in docs.orderBy("doc_id").select(F.xxhash64("text").alias("k")).collect()))
    assert len(joined) == 4 and joined[key[5]] == joined[key[120]] != joined[key[60]] == joined[key[121]]
    assert made["line-buckets"][0] > 75, made
    assert max(made["line-rest"]) < 60 and max(made["line-texts"]) < 60, made


@pytest.mark.parametrize("whole", [1, 1000])
def test_near_copies_are_found_in_dealt_buckets(spark, monkeypatch, whole):
    """One class of 30 variants and single lines, with every bucket dealt and with none."""
    monkeypatch.setattr(L, "WHOLE", whole)
    rng = random.Random(11)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n)).strip() + "."
    first = letters(300)
    lines = [first] + [first[:-1] + f" {i:02d}" for i in range(29)] + [letters(300) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    got = {r["doc_id"]: r["n_dropped"] for r in L.drop_lines(docs, counts=True).collect()}
    assert got == {i: int(0 < i < 30) for i in range(len(lines))}
