"""Line dedup: steps that read the same rows twice share one shuffle."""

import random

import pytest

from textlab.llm import lines as L
from textlab.session import stage_table


@pytest.fixture(scope="module")
def banded(spark):
    rng = random.Random(13)
    letters = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n)).strip() + "."
    first = letters(200)
    lines = [first] + [first[:-1] + f" {i:02d}" for i in range(29)] + [letters(200) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id bigint, text string")
    return stage_table(L._banded(docs), "line-bands")


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()


def shuffles(plan):
    return sum("Exchange hashpartitioning" in x and "ReusedExchange" not in x for x in plan), sum("ReusedExchange" in x for x in plan)


def test_buckets_and_their_sizes_share_a_shuffle(banded):
    assert shuffles(final_plan(L._bucketed(banded))) == (1, 1)


@pytest.mark.parametrize("whole", [1, 1000])
def test_both_sides_of_the_partner_search_share_a_shuffle(spark, banded, monkeypatch, whole):
    monkeypatch.setattr(L, "WHOLE", whole)
    buckets = stage_table(L._bucketed(banded), "line-buckets")
    assert {r["large"] for r in buckets.collect()} == {whole == 1}
    signed = stage_table(buckets.join(banded.select("k", *(f"s{w}" for w in range(L.WORDS))), "k"), "line-signed")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = L._with_partner(signed)
        assert shuffles(final_plan(found)) == (1, 1)
        assert found.where("bucket is null").count() == 0 and found.select("k").distinct().count() >= 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
