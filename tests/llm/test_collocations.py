"""Collocations against DuckDB and a plain count."""

import collections
import re

import duckdb
import numpy as np

from conftest import SF_SMALL
from conftest_data import edge_docs
from textlab.llm import collocations as C
from textlab.llm.queries import OP13_SQL, QUERIES

LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def plain(docs, longest=5, least=100, top=2000):
    counts, n = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for m in range(1, longest + 1):
                counts.update((lang, tuple(w[i:i + m])) for i in range(len(w) - m + 1))
    candidates = {k: a for k, a in counts.items() if a >= least and len(k[1]) > 1}
    gone = {(lang, w[i:i + m]) for (lang, w), f in candidates.items() for m in range(2, len(w)) for i in range(len(w) - m + 1)
            if 100 * f >= 100 * counts[lang, w[i:i + m]]}
    found = collections.defaultdict(list)
    for (lang, w), a in candidates.items():
        if (lang, w) not in gone:
            score, _, l, r = min((1000 * a * n[lang] // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]],
                                  counts[lang, w[k:]]) for k in range(1, len(w)))
            found[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in found.items()
                  for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_op13_equals_sql_and_plain(spark):
    mine = got(QUERIES["op13_marginal_collocations"][0](spark, SF_SMALL))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF_SMALL}/documents.parquet'")
    assert mine == sorted(con.sql(OP13_SQL).fetchall())
    docs = con.sql("SELECT lang, text FROM documents").fetchall()
    assert mine == plain(docs)


def test_all_ways_agree(spark):
    """Few frequent words and pairs, or too many of them to broadcast: one result."""
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    docs = [tuple(r) for r in df.select("lang", "text").collect()]
    want = plain(docs, least=20, top=50)
    assert got(C.collocations(df, least=20, top=50)) == want
    assert got(C.collocations(df, least=20, top=50, max_words=0)) == want
    assert got(C.collocations(df, least=20, top=50, max_pairs=0)) == want
    assert got(C.collocations(df.repartition(7), least=20, top=50)) == want


def test_edges(spark):
    """Nulls, a language called und, empty and long texts, control characters, ties, repeated rows, clashing names."""
    docs = edge_docs(spark)
    rows = [tuple(r) for r in docs.select("lang", "text").collect()]
    assert got(C.collocations(docs, least=2)) == plain(rows, least=2)
    more = [(None, "a b c. a b c! A b\x01 c a\tb"), ("und", "a b c"), ("x", "a\xa0b a\xa0b   \x1f é É é É"), ("x", None), ("y", ""),
            ("x", "b c b c b c, b c"), ("z", "k l m n o p q\nk l m n o p q;k l m n o p q"), ("z", "l m n o p")] * 2
    df = spark.createDataFrame([(*m, 1, "x", "y") for m in more], "lang string, text string, n int, words string, w1 string")
    for most in (C.MAX_WORDS, 0):
        assert got(C.collocations(df, least=2, max_words=most)) == plain(more, least=2)
    assert got(C.collocations(df.limit(0))) == []


def test_lead_windows_stop_at_breaks_and_rare_pairs():
    ids = np.array([3, 4, -1, 5, 6, 7], np.int32)
    rows = list(zip(*(c.tolist() for c in C.window_columns(ids, 3)), strict=True))
    assert rows == [(3, 4, -1), (4, -1, -1), (5, 6, 7), (6, 7, -1), (7, -1, -1)]
    pairs = np.array([5 << 32 | 6], np.int64)
    rows = list(zip(*(c.tolist() for c in C.window_columns(ids, 3, pairs)), strict=True))
    assert rows == [(3, -1, -1), (4, -1, -1), (5, 6, -1), (6, -1, -1), (7, -1, -1)]


def test_products_beyond_64_bits(spark):
    """The score's arithmetic on counts whose products need more than 64 bits."""
    from pyspark.sql import functions as F
    a, l, r, n = 10 ** 13 + 7, 3 * 10 ** 13 + 1, 2 * 10 ** 13 + 9, 10 ** 16 + 3
    df = spark.createDataFrame([(a, l, r, n)], "a bigint, l bigint, r bigint, n bigint")
    assert df.select(F.expr(C.SCORE).alias("s")).first()["s"] == 1000 * a * n // (l * r)
