"""Registered queries: profiling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare as C
from ..operators import profile as P
from .fixtures import view
from .q_compare import HASH_DUCK, M_CTE, merged
from .registry import register

def split_col():
    """Fixture split: train is id % 10 < 7, test the rest."""
    return F.when(F.col("id") % 10 < 7, F.lit("train")).otherwise(F.lit("test"))
SPLIT_DUCK = "CASE WHEN id % 10 < 7 THEN 'train' ELSE 'test' END"
KW_CLEAN_DUCK = "coalesce(replace(keyword, '%20', ' '), 'None')"
NA_LIST_DUCK = ", ".join("'" + s.replace("'", "''") + "'" for s in T.NA_STRINGS)


def tw_clean(spark, sf):
    """tw with the keyword cleaned as on load (P2) and the split column."""
    return view(spark, sf, "tw").select("id", T.keyword_clean("keyword").alias("keyword"), "location", "text",
                                        "target", split_col().alias("split"))


TWC = f"twc AS (SELECT id, {KW_CLEAN_DUCK} AS keyword, location, text, target, {SPLIT_DUCK} AS split FROM tw)"


@register("na_tokens", "id:i keyword:s",
          f"SELECT id, CASE WHEN keyword IN ({NA_LIST_DUCK}) THEN NULL ELSE keyword END AS keyword FROM tw", ["tw"])
def q_na_tokens(spark, sf):
    return view(spark, sf, "tw").select("id", T.na_to_null("keyword").alias("keyword"))


@register("keyword_clean", "id:i keyword:s", f"SELECT id, {KW_CLEAN_DUCK} AS keyword FROM tw", ["tw"])
def q_keyword_clean(spark, sf):
    return view(spark, sf, "tw").select("id", T.keyword_clean("keyword").alias("keyword"))


@register("none_to_null", "id:i keyword:s", f"SELECT id, nullif({KW_CLEAN_DUCK}, 'None') AS keyword FROM tw", ["tw"])
def q_none_to_null(spark, sf):
    return view(spark, sf, "tw").select("id", T.none_to_null(T.keyword_clean("keyword")).alias("keyword"))


@register("text_prefix", "id:i text:s", "SELECT id, concat('query: ', text) AS text FROM tw", ["tw"])
def q_text_prefix(spark, sf):
    return view(spark, sf, "tw").select("id", T.text_prefix("text", T.QUERY_PREFIX).alias("text"))


@register("target_distribution", "target:i n:i",
          "SELECT target, count(*) AS n FROM tw WHERE target IS NOT NULL GROUP BY target", ["tw"])
def q_target_distribution(spark, sf):
    return P.target_distribution(view(spark, sf, "tw").where(F.col("target").isNotNull()))


@register("value_counts_with_null", "keyword:s n:i",
          f"SELECT nullif({KW_CLEAN_DUCK}, 'None') AS keyword, count(*) AS n FROM tw GROUP BY 1 "
          "ORDER BY n DESC, keyword NULLS FIRST LIMIT 20", ["tw"])
def q_value_counts_with_null(spark, sf):
    df = view(spark, sf, "tw").select(T.none_to_null(T.keyword_clean("keyword")).alias("keyword"))
    return C.value_counts(df, "keyword", 20, dropna=False)


@register("missing_counts", "column:s none_count:i null_count:i total_missing:i",
          f"WITH {TWC} SELECT 'keyword' AS \"column\", count(*) FILTER (WHERE keyword = 'None') AS none_count, "
          "count(*) FILTER (WHERE keyword IS NULL) AS null_count, "
          "count(*) FILTER (WHERE keyword = 'None') + count(*) FILTER (WHERE keyword IS NULL) AS total_missing FROM twc "
          "UNION ALL SELECT 'location', count(*) FILTER (WHERE location = 'None'), count(*) FILTER (WHERE location IS NULL), "
          "count(*) FILTER (WHERE location = 'None') + count(*) FILTER (WHERE location IS NULL) FROM twc", ["tw"])
def q_missing_counts(spark, sf):
    return P.missing_counts(tw_clean(spark, sf), ["keyword", "location"])


@register("distinct_values", "column:s n_distinct:i",
          "SELECT 'keyword' AS \"column\", count(DISTINCT keyword) AS n_distinct FROM tw "
          "UNION ALL SELECT 'location', count(DISTINCT location) FROM tw", ["tw"])
def q_distinct_values(spark, sf):
    return P.distinct_values(view(spark, sf, "tw"), ["keyword", "location"])


_PROFILE_COLS = [("id", "bigint"), ("keyword", "string"), ("location", "string"), ("text", "string"),
                 ("target", "int"), ("predicted", "int")]


def _profile_sql():
    parts = [f"SELECT '{c}' AS \"column\", '{t}' AS dtype, count({c}) AS non_null, count(DISTINCT {c}) AS n_distinct, "
             f"count(*) AS n_rows, {len(_PROFILE_COLS)} AS n_cols FROM tw" for c, t in _PROFILE_COLS]
    return " UNION ALL ".join(parts)


@register("dataset_profile", "column:s dtype:s non_null:i n_distinct:i n_rows:i n_cols:i", _profile_sql(), ["tw"])
def q_dataset_profile(spark, sf):
    return P.dataset_profile(view(spark, sf, "tw"))


@register("length_stats", "split:s mean_len:d std_len:d",
          f"SELECT {SPLIT_DUCK} AS split, avg(length(text)) AS mean_len, stddev_samp(length(text)) AS std_len "
          "FROM tw GROUP BY 1", ["tw"])
def q_length_stats(spark, sf):
    return P.length_stats(tw_clean(spark, sf), "text", "split")


@register("histogram_equal_width", "series:s bin:i lo:d hi:d n:i",
          f"""WITH x AS (SELECT {SPLIT_DUCK} AS series, CAST(length(text) AS DOUBLE) AS x FROM tw),
 s0 AS (SELECT series, min(x) AS mn, max(x) AS mx FROM x GROUP BY series),
 s AS (SELECT series, CASE WHEN mn = mx THEN mn - 0.5 ELSE mn END AS lo, CASE WHEN mn = mx THEN mx + 0.5 ELSE mx END AS hi FROM s0),
 c AS (SELECT x.series, CAST(least(floor((x.x - s.lo) * 50 / (s.hi - s.lo)), 49) AS INT) AS bin, count(*) AS n
       FROM x JOIN s ON x.series = s.series GROUP BY 1, 2),
 g AS (SELECT series, lo, hi, unnest(range(0, 50)) AS bin FROM s)
SELECT g.series, g.bin, g.lo + g.bin * ((g.hi - g.lo) / 50) AS lo, g.lo + (g.bin + 1) * ((g.hi - g.lo) / 50) AS hi,
 coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.series = c.series AND g.bin = c.bin""", ["tw"])
def q_histogram_equal_width(spark, sf):
    return P.histogram_equal_width(tw_clean(spark, sf), T.text_length("text"), 50, "split")


@register("histogram_int_edges", "series:s bin:i n:i",
          f"""WITH {M_CTE}, x AS (SELECT 'errors' AS series, {HASH_DUCK} AS x FROM m WHERE predicted_target <> actual_target
 UNION ALL SELECT 'all', {HASH_DUCK} FROM m),
 c AS (SELECT series, CAST(least(floor(x), 8) AS INT) AS bin, count(*) AS n FROM x WHERE x BETWEEN 0 AND 9 GROUP BY 1, 2),
 g AS (SELECT series, unnest(range(0, 9)) AS bin FROM (SELECT DISTINCT series FROM x))
SELECT g.series, g.bin, coalesce(c.n, 0) AS n FROM g LEFT JOIN c ON g.series = c.series AND g.bin = c.bin""", ["tw"])
def q_histogram_int_edges(spark, sf):
    m = merged(spark, sf)
    both = (C.misclassified(m).select(F.lit("errors").alias("series"), T.hashtag_count("text").alias("h"))
            .unionByName(m.select(F.lit("all").alias("series"), T.hashtag_count("text").alias("h"))))
    return P.histogram_int_edges(both, "h", range(10), "series")


def _sides(spark, sf):
    t = tw_clean(spark, sf)
    return t.where(F.col("split") == "train"), t.where(F.col("split") == "test")


@register("keyword_overlap", "n_a:i n_b:i n_common:i pct_a_in_b:d pct_b_in_a:d",
          f"""WITH {TWC}, a AS (SELECT DISTINCT keyword FROM twc WHERE split = 'train' AND keyword IS NOT NULL),
 b AS (SELECT DISTINCT keyword FROM twc WHERE split = 'test' AND keyword IS NOT NULL),
 c AS (SELECT keyword FROM a INTERSECT SELECT keyword FROM b)
SELECT (SELECT count(*) FROM a) AS n_a, (SELECT count(*) FROM b) AS n_b, (SELECT count(*) FROM c) AS n_common,
 CAST((SELECT count(*) FROM c) AS DOUBLE) / (SELECT count(*) FROM a) * 100 AS pct_a_in_b,
 CAST((SELECT count(*) FROM c) AS DOUBLE) / (SELECT count(*) FROM b) * 100 AS pct_b_in_a""", ["tw"])
def q_keyword_overlap(spark, sf):
    a, b = _sides(spark, sf)
    return P.keyword_overlap(a, b)


@register("keyword_intersect", "keyword:s",
          f"WITH {TWC} SELECT keyword FROM twc WHERE split = 'train' AND keyword IS NOT NULL "
          "INTERSECT SELECT keyword FROM twc WHERE split = 'test'", ["tw"])
def q_keyword_intersect(spark, sf):
    a, b = _sides(spark, sf)
    return P.keyword_intersect(a, b)


@register("keyword_only_test", "keyword:s",
          f"WITH {TWC} SELECT keyword FROM twc WHERE split = 'test' AND keyword IS NOT NULL "
          "EXCEPT SELECT keyword FROM twc WHERE split = 'train'", ["tw"])
def q_keyword_only_test(spark, sf):
    a, b = _sides(spark, sf)
    return P.keyword_except(b, a)


@register("keyword_only_train", "keyword:s",
          f"WITH {TWC} SELECT keyword FROM twc WHERE split = 'train' AND keyword IS NOT NULL "
          "EXCEPT SELECT keyword FROM twc WHERE split = 'test'", ["tw"])
def q_keyword_only_train(spark, sf):
    a, b = _sides(spark, sf)
    return P.keyword_except(a, b)


def _raw_sides(spark, sf):
    t = view(spark, sf, "tw").select("id", "keyword", split_col().alias("split"))
    return t.where(F.col("split") == "train"), t.where(F.col("split") == "test")


@register("overlap_flag", "id:i keyword:s",
          f"SELECT id, keyword FROM tw WHERE {SPLIT_DUCK} = 'test' AND keyword IN "
          f"(SELECT keyword FROM tw WHERE {SPLIT_DUCK} = 'train' AND keyword IS NOT NULL)", ["tw"])
def q_overlap_flag(spark, sf):
    a, b = _raw_sides(spark, sf)
    return P.overlap_flag(b.select("id", "keyword"), a)


@register("overlap_flag_anti", "id:i keyword:s",
          f"SELECT id, keyword FROM tw t WHERE {SPLIT_DUCK} = 'test' AND NOT EXISTS "
          f"(SELECT 1 FROM tw u WHERE (CASE WHEN u.id % 10 < 7 THEN 'train' ELSE 'test' END) = 'train' "
          "AND u.keyword IS NOT NULL AND u.keyword = t.keyword)", ["tw"])
def q_overlap_flag_anti(spark, sf):
    a, b = _raw_sides(spark, sf)
    return P.overlap_flag(b.select("id", "keyword"), a, anti=True)


@register("head_n", "id:i keyword:s location:s target:i",
          "SELECT id, keyword, location, target FROM tw ORDER BY id LIMIT 5", ["tw"])
def q_head_n(spark, sf):
    return P.head_n(view(spark, sf, "tw").select("id", "keyword", "location", "target"), "id", 5)
