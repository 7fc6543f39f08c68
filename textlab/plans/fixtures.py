"""Test views over the given tables (see FIXTURES.md).

The given documents have no links, no ``#word`` and no nulls; these views add
them so each query tests something. Every view is derived by Spark from the
given tables, so its size grows with them. Each view is kept as SQL text that
runs in Spark SQL; the oracle side (DuckDB) reuses the same text except where
the two dialects differ (``word_vectors``).
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

from ..session import spread

BASE_TABLES = ["documents", "labels", "embeddings", "events", "conversations", "benchmark", "pages"]

TW = """
SELECT d.doc_id AS id,
 CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.doc_id % 17 = 1 THEN 'None' ELSE concat(d.source, '%20', d.lang) END AS keyword,
 CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE d.lang END AS location,
 concat(d.text,
  CASE WHEN d.doc_id % 4 = 0 THEN concat(' #', d.lang, ' #', d.source) WHEN d.doc_id % 4 = 1 THEN ' #été ##x # y' ELSE '' END,
  CASE WHEN d.doc_id % 5 = 0 THEN concat(' http://t.co/', CAST(d.doc_id AS STRING)) WHEN d.doc_id % 5 = 1 THEN ' https://t.co/a HTTP://T.CO' ELSE '' END) AS text,
 l.quality AS target, 1 - l.toxic AS predicted
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
"""

PREDS = """
SELECT run, id, score, CAST(score > 0.5 AS INT) AS target FROM (
 SELECT concat('run', CAST(v.r AS STRING)) AS run, l.doc_id AS id,
  CAST(0.45 AS DOUBLE) * l.quality + CAST(0.55 AS DOUBLE) * (CAST((l.doc_id * 7919 + v.r * 104729) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE)) AS score
 FROM labels l CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(r)) s
"""

# Same rows as PREDS, with the five run numbers exploded instead of cross-joined.
PREDS_SPARK = """
SELECT run, id, score, CAST(score > 0.5 AS INT) AS target FROM (
 SELECT concat('run', CAST(v.r AS STRING)) AS run, l.doc_id AS id,
  CAST(0.45 AS DOUBLE) * l.quality + CAST(0.55 AS DOUBLE) * (CAST((l.doc_id * 7919 + v.r * 104729) % 10007 AS DOUBLE) / CAST(10007 AS DOUBLE)) AS score
 FROM labels l LATERAL VIEW explode(array(0, 1, 2, 3, 4)) v AS r) s
"""

RUN_WEIGHTS = """
SELECT concat('run', CAST(v.r AS STRING)) AS run, CASE WHEN v.r = 3 THEN 2 ELSE 1 END AS w
FROM (VALUES (0), (1), (2), (3), (4)) AS v(r)
"""

RUNLOG = """
SELECT concat('run', CAST(user_id % 3 AS STRING)) AS run, event_id % 4 + 1 AS epoch, event_id AS batch,
 32 AS n, event_id * 7 % 33 AS correct, value / 100 AS loss FROM events
"""

REPLIES = """
SELECT doc_id AS id, CASE doc_id % 5 WHEN 0 THEN '1' WHEN 1 THEN 'Answer: 0' WHEN 2 THEN '10' WHEN 3 THEN ' 1.' ELSE 'not sure' END AS reply
FROM documents
"""

CENTROIDS = """
SELECT CAST(floor(vec_id / 25) AS INT) AS cluster, embedding AS cvec FROM embeddings WHERE vec_id % 25 = 0
"""

POINTS = """
SELECT vec_id AS id, embedding AS vec, CASE WHEN label < 5 THEN 0 ELSE 1 END AS target, vec_id % 5 = 0 AS is_query FROM embeddings
"""

HIDDEN = """
SELECT CAST(floor(vec_id / 8) AS BIGINT) AS id, vec_id % 8 AS pos,
 CASE WHEN vec_id % 8 < CAST(floor(vec_id / 8) AS BIGINT) % 9 THEN 1 ELSE 0 END AS mask, embedding AS vec FROM embeddings
"""

# Every distinct token but a third (by hash), with the embedding that its md5 picks.
WORD_VECTORS_SPARK = r"""
SELECT t.tok, e.embedding AS vec FROM (
 SELECT tok, cast(conv(substring(md5(tok), 1, 8), 16, 10) AS BIGINT) AS h
 FROM (SELECT DISTINCT explode(split(text, '\\s+')) AS tok FROM documents) x WHERE tok <> '') t
JOIN embeddings e ON e.vec_id = t.h % (SELECT count(*) FROM embeddings) WHERE t.h % 3 <> 0
"""

WORD_VECTORS_DUCKDB = r"""
SELECT t.tok, e.embedding AS vec FROM (
 SELECT tok, CAST(concat('0x', substring(md5(tok), 1, 8)) AS BIGINT) AS h
 FROM (SELECT DISTINCT unnest(regexp_split_to_array(text, '\s+')) AS tok FROM documents) x WHERE tok <> '') t
JOIN embeddings e ON e.vec_id = t.h % (SELECT count(*) FROM embeddings) WHERE t.h % 3 <> 0
"""

SPARK_VIEWS = {
    "tw": TW, "preds": PREDS_SPARK, "run_weights": RUN_WEIGHTS, "runlog": RUNLOG, "replies": REPLIES,
    "centroids": CENTROIDS, "points": POINTS, "hidden": HIDDEN, "word_vectors": WORD_VECTORS_SPARK,
}
DUCKDB_VIEWS = dict(SPARK_VIEWS, preds=PREDS, word_vectors=WORD_VECTORS_DUCKDB)
# Oracle CTE order (a view may only use earlier ones or base tables).
VIEW_ORDER = ["tw", "preds", "run_weights", "runlog", "replies", "centroids", "points", "hidden", "word_vectors"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


VIEW_PREFIX = "__textlab_"  # private temp-view names: the caller's own views stay untouched


def register_base(spark: SparkSession, sf_dir: str, names=None) -> None:
    for n in BASE_TABLES if names is None else names:
        p = os.path.join(sf_dir, f"{n}.parquet")
        if os.path.exists(p) or "://" in sf_dir:
            spark.read.parquet(p).createOrReplaceTempView(VIEW_PREFIX + n)


def _private(sql: str, tables) -> str:
    for t in tables:
        sql = re.sub(rf"\b{t}\b", VIEW_PREFIX + t, sql)
    return sql


# Base tables each view reads.
VIEW_TABLES = {"tw": ["documents", "labels"], "preds": ["labels"], "run_weights": [], "runlog": ["events"],
               "replies": ["documents"], "centroids": ["embeddings"], "points": ["embeddings"],
               "hidden": ["embeddings"], "word_vectors": ["documents", "embeddings"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture view as a DataFrame (analysed at once, so later view
    replacement does not change it)."""
    register_base(spark, sf_dir, VIEW_TABLES[name])
    if name == "word_vectors":  # cuts every text into words: too much for the one task that reads a row group
        spread(table(spark, sf_dir, "documents").select("text")).createOrReplaceTempView(VIEW_PREFIX + "documents")
    return spark.sql(_private(SPARK_VIEWS[name], VIEW_TABLES[name]))


def oracle_with(names, body: str) -> str:
    """DuckDB SQL: the fixture views ``names`` as CTEs, then ``body``."""
    wanted = [n for n in VIEW_ORDER if n in set(names)]
    if not wanted:
        return body
    ctes = ",\n".join(f"{n} AS ({DUCKDB_VIEWS[n]})" for n in wanted)
    body = body.strip()
    if body[:4].upper() == "WITH":
        return f"WITH {ctes},\n{body[4:]}"
    return f"WITH {ctes}\n{body}"
