"""Row-wise text functions against plain-Python oracles on hand-made edge cases."""

import re

import pytest
from pyspark.sql import functions as F

from textlab.functions import text as T

TEXTS = [
    "Forest fire near La Ronge Sask. Canada",
    "  leading and trailing  ",
    "",
    "ALL CAPS HERE A1 #USA U.S. 12 I",
    "tabs\tand\nnewlines\r\nand nbsp em　ideographic",
    "#été ##x # y #a_b #1",
    "http://t.co/x and HTTP://T.CO and https://a",
    "mixed Ünïcödé ÉCOLE ß ǅ",
    "punct!!! ... (a,b) 'quote' \"dq\"",
]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id INT, text STRING")


def _col(df, expr):
    return [r[0] for r in df.orderBy("id").select(expr).collect()]


def test_text_length(df):
    assert _col(df, T.text_length("text")) == [len(t) for t in TEXTS]


def test_tokenize_ws_equals_str_split(df):
    assert _col(df, T.tokenize_ws("text")) == [t.split() for t in TEXTS]
    assert _col(df, T.tokenize_ws("text", lower=True)) == [t.lower().split() for t in TEXTS]


def test_tokenize_words(df):
    pat = re.compile(r"\w+|[^\s\w]")
    assert _col(df, T.tokenize_words("text")) == [pat.findall(t) for t in TEXTS]


def test_contains_link(df):
    assert _col(df, T.contains_link("text")) == [("http://" in t or "https://" in t) for t in TEXTS]


def test_hashtag_count(df):
    assert _col(df, T.hashtag_count("text")) == [len(re.findall(r"#\w+", t)) for t in TEXTS]


def test_caps_word_count(df):
    want = [len([w for w in t.split() if w.isupper() and len(w) > 1]) for t in TEXTS]
    assert _col(df, T.caps_word_count("text")) == want


def test_keyword_clean_and_none(spark):
    d = spark.createDataFrame([(1, None), (2, "None"), (3, "bush%20fire"), (4, "a%20b%20c")], "id INT, k STRING")
    assert _col(d, T.keyword_clean("k")) == ["None", "None", "bush fire", "a b c"]
    assert _col(d, T.none_to_null(T.keyword_clean("k"))) == [None, None, "bush fire", "a b c"]


def test_na_to_null(spark):
    vals = ["", "NA", "n/a", "null", "None", "#N/A N/A", "keep", "na", " NA"]
    d = spark.createDataFrame(list(enumerate(vals)), "id INT, v STRING")
    assert _col(d, T.na_to_null("v")) == [None, None, None, None, None, None, "keep", "na", " NA"]


def test_response_parse(spark):
    d = spark.createDataFrame([(0, "1"), (1, "Answer: 0"), (2, "10"), (3, " 1."), (4, "not sure")], "id INT, r STRING")
    assert _col(d, T.response_parse("r")) == [1, 0, 0, 1, None]
    with pytest.raises(Exception):
        d.select(T.response_parse_strict("r")).collect()


def test_md5_uniform_range_and_determinism(spark):
    d = spark.range(2000).repartition(7)
    u1 = dict(d.select("id", T.md5_uniform(42, "id").alias("u")).collect())
    u2 = dict(spark.range(2000).select("id", T.md5_uniform(42, "id").alias("u")).collect())
    assert u1 == u2
    assert all(0.0 <= v < 1.0 for v in u1.values())
    assert 0.45 < sum(u1.values()) / len(u1) < 0.55
