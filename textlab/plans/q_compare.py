"""Registered queries: error analysis."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare as C
from .fixtures import view
from .registry import register

# DuckDB spellings of the shared regular expressions.
WS_DUCK = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]+"
HASHTAG_DUCK = r"#[\p{L}\p{N}_]+"

M_CTE = """m AS (SELECT p.id, a.keyword, a.location, a.text, p.predicted AS predicted_target, a.target AS actual_target
 FROM (SELECT id, predicted FROM tw WHERE predicted IS NOT NULL) p
 JOIN (SELECT id, keyword, location, text, target FROM tw WHERE target IS NOT NULL) a ON p.id = a.id)"""

LINK_DUCK = "(CASE WHEN contains(text, 'http://') OR contains(text, 'https://') THEN 1 ELSE 0 END)"
HASH_DUCK = f"len(regexp_extract_all(text, '{HASHTAG_DUCK}'))"
CAPS_DUCK = (f"len(list_filter(regexp_split_to_array(text, '{WS_DUCK}'), "
             "lambda w: length(w) > 1 AND w = upper(w) AND w <> lower(w)))")
LEN_DUCK = "length(text)"


def merged(spark, sf):
    """Predictions joined to truth on the tw fixture (J1 input)."""
    tw = view(spark, sf, "tw")
    preds = tw.where(F.col("predicted").isNotNull()).select("id", F.col("predicted").alias("target"))
    truth = tw.where(F.col("target").isNotNull()).select("id", "keyword", "location", "text", "target")
    return C.pred_actual_join(preds, truth)


def _m(body):
    return f"WITH {M_CTE}\n{body}"


@register("pred_actual_join", "id:i keyword:s location:s text:s predicted_target:i actual_target:i",
          _m("SELECT * FROM m"), ["tw"])
def q_pred_actual_join(spark, sf):
    return merged(spark, sf)


@register("misclassified_filter", "id:i predicted_target:i actual_target:i",
          _m("SELECT id, predicted_target, actual_target FROM m WHERE predicted_target <> actual_target"), ["tw"])
def q_misclassified(spark, sf):
    return C.misclassified(merged(spark, sf))


@register("correct_filter", "id:i predicted_target:i actual_target:i",
          _m("SELECT id, predicted_target, actual_target FROM m WHERE predicted_target = actual_target"), ["tw"])
def q_correct(spark, sf):
    return C.correct(merged(spark, sf))


@register("error_table", "id:i keyword:s location:s text:s actual_target:i predicted_target:i",
          _m("SELECT id, keyword, location, text, actual_target, predicted_target FROM m "
             "WHERE predicted_target <> actual_target ORDER BY id"), ["tw"])
def q_error_table(spark, sf):
    return C.error_table(merged(spark, sf))


@register("sort_by_id", "id:i keyword:s target:i",
          "SELECT id, keyword, target FROM tw ORDER BY id", ["tw"])
def q_sort_by_id(spark, sf):
    return view(spark, sf, "tw").select("id", "keyword", "target").orderBy("id")


@register("attach_predictions", "id:i keyword:s target:i",
          "SELECT t.id, t.keyword, p.target FROM tw t LEFT JOIN (SELECT id, target FROM preds WHERE run = 'run0') p "
          "ON t.id = p.id", ["tw", "preds"])
def q_attach(spark, sf):
    rows = view(spark, sf, "tw").select("id", "keyword")
    preds = view(spark, sf, "preds").where(F.col("run") == "run0")
    return C.attach_predictions(rows, preds)


@register("misclassification_rate", "n_rows:i n_errors:i rate:d",
          _m("SELECT count(*) AS n_rows, count(*) FILTER (WHERE predicted_target <> actual_target) AS n_errors, "
             "CAST(count(*) FILTER (WHERE predicted_target <> actual_target) AS DOUBLE) / count(*) AS rate FROM m"),
          ["tw"])
def q_rate(spark, sf):
    return C.misclassification_rate(merged(spark, sf))


def _group_rate_sql(key):
    return _m(f"SELECT {key}, count(*) FILTER (WHERE predicted_target <> actual_target) AS n_err, count(*) AS n, "
              f"CAST(count(*) FILTER (WHERE predicted_target <> actual_target) AS DOUBLE) / count(*) AS rate "
              f"FROM m WHERE {key} IS NOT NULL GROUP BY {key} ORDER BY rate DESC, {key} LIMIT 10")


@register("group_error_rate", "keyword:s n_err:i n:i rate:d", _group_rate_sql("keyword"), ["tw"])
def q_group_error_rate(spark, sf):
    return C.group_error_rate(merged(spark, sf), "keyword")


@register("group_error_rate_location", "location:s n_err:i n:i rate:d", _group_rate_sql("location"), ["tw"])
def q_group_error_rate_loc(spark, sf):
    return C.group_error_rate(merged(spark, sf), "location")


@register("rate_align", "keyword:s n_err:i n:i rate:d",
          _m("SELECT coalesce(e.keyword, a.keyword) AS keyword, e.n_err, a.n, "
             "coalesce(CAST(e.n_err AS DOUBLE) / a.n, 0.0) AS rate FROM "
             "(SELECT keyword, count(*) AS n_err FROM m WHERE predicted_target <> actual_target AND keyword IS NOT NULL "
             "GROUP BY keyword) e FULL OUTER JOIN "
             "(SELECT keyword, count(*) AS n FROM m WHERE keyword IS NOT NULL GROUP BY keyword) a ON e.keyword = a.keyword"),
          ["tw"])
def q_rate_align(spark, sf):
    m = merged(spark, sf)
    num = C.value_counts(C.misclassified(m), "keyword", count_name="n_err")
    den = C.value_counts(m, "keyword", count_name="n")
    return C.rate_align(num, den, "keyword")


@register("value_counts_top", "keyword:s n:i",
          _m("SELECT keyword, count(*) AS n FROM m WHERE keyword IS NOT NULL GROUP BY keyword "
             "ORDER BY n DESC, keyword LIMIT 10"), ["tw"])
def q_value_counts_top(spark, sf):
    return C.value_counts(merged(spark, sf), "keyword", 10)


@register("value_counts_top_errors", "location:s n:i",
          _m("SELECT location, count(*) AS n FROM m WHERE location IS NOT NULL AND predicted_target <> actual_target "
             "GROUP BY location ORDER BY n DESC, location LIMIT 10"), ["tw"])
def q_value_counts_top_err(spark, sf):
    return C.value_counts(C.misclassified(merged(spark, sf)), "location", 10)


@register("length_by_correctness", "correct:i avg_len:d",
          _m("SELECT CAST(predicted_target = actual_target AS INT) AS correct, avg(length(text)) AS avg_len "
             "FROM m GROUP BY 1"), ["tw"])
def q_len_by_correct(spark, sf):
    return C.length_by_correctness(merged(spark, sf))


def _errors_vs_all_sql(expr, name):
    return _m(f"SELECT 'errors' AS grp, avg(CASE WHEN predicted_target <> actual_target THEN {expr} END) AS {name} "
              f"FROM m UNION ALL SELECT 'all' AS grp, avg({expr}) AS {name} FROM m")


@register("link_share", "grp:s share:d", _errors_vs_all_sql(LINK_DUCK, "share"), ["tw"])
def q_link_share(spark, sf):
    return C.link_share(merged(spark, sf))


@register("hashtag_avg", "grp:s avg_hashtags:d", _errors_vs_all_sql(HASH_DUCK, "avg_hashtags"), ["tw"])
def q_hashtag_avg(spark, sf):
    return C.hashtag_avg(merged(spark, sf))


@register("caps_avg", "grp:s avg_caps:d", _errors_vs_all_sql(CAPS_DUCK, "avg_caps"), ["tw"])
def q_caps_avg(spark, sf):
    return C.caps_avg(merged(spark, sf))


@register("error_direction", "false_positives:i false_negatives:i",
          _m("SELECT count(*) FILTER (WHERE predicted_target > actual_target) AS false_positives, "
             "count(*) FILTER (WHERE predicted_target < actual_target) AS false_negatives FROM m"), ["tw"])
def q_error_direction(spark, sf):
    return C.error_direction(merged(spark, sf))


FEATS = ["contains_link", "hashtag_count", "caps_word_count", "tweet_length"]
FEAT_DUCK = {"contains_link": LINK_DUCK, "hashtag_count": HASH_DUCK, "caps_word_count": CAPS_DUCK,
             "tweet_length": LEN_DUCK}


def _corr_sql():
    feats = ", ".join(f"CAST({FEAT_DUCK[f]} AS DOUBLE) AS {f}" for f in FEATS)
    aggs = [f"stddev_pop({f}) AS s_{f}" for f in FEATS]
    aggs += [f"covar_pop({a}, {b}) AS c_{a}_{b}" for a, b in product(FEATS, FEATS)]
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, c_{a}_{b} / nullif(s_{a} * s_{b}, 0) AS r FROM agg"
        for a, b in product(FEATS, FEATS))
    return (f"WITH {M_CTE}, f AS (SELECT {feats} FROM m WHERE predicted_target <> actual_target), "
            f"agg AS (SELECT {', '.join(aggs)} FROM f)\n{rows}")


@register("feature_correlation", "a:s b:s r:d", _corr_sql(), ["tw"])
def q_feature_corr(spark, sf):
    errs = C.with_features(C.misclassified(merged(spark, sf)))
    return C.feature_correlation(errs, FEATS)


@register("top_words", "word:s n:i",
          _m(f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '{WS_DUCK}')) AS word "
             "FROM m WHERE predicted_target <> actual_target) w WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 10"),
          ["tw"])
def q_top_words(spark, sf):
    return C.top_words(C.misclassified(merged(spark, sf)))


@register("top_words_correct", "word:s n:i",
          _m(f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(lower(text), '{WS_DUCK}')) AS word "
             "FROM m WHERE predicted_target = actual_target) w WHERE word <> '' GROUP BY word ORDER BY n DESC, word LIMIT 10"),
          ["tw"])
def q_top_words_correct(spark, sf):
    return C.top_words(C.correct(merged(spark, sf)))


# Row-wise text features on the whole tw fixture.

@register("text_length", "id:i text_length:i", "SELECT doc_id AS id, length(text) AS text_length FROM documents")
def q_text_length(spark, sf):
    from .fixtures import table
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.text_length("text").alias("text_length"))


@register("contains_link", "id:i contains_link:i", f"SELECT id, {LINK_DUCK} AS contains_link FROM tw", ["tw"])
def q_contains_link(spark, sf):
    return view(spark, sf, "tw").select("id", T.contains_link("text").cast("int").alias("contains_link"))


@register("hashtag_count", "id:i hashtag_count:i", f"SELECT id, {HASH_DUCK} AS hashtag_count FROM tw", ["tw"])
def q_hashtag_count(spark, sf):
    return view(spark, sf, "tw").select("id", T.hashtag_count("text").alias("hashtag_count"))


@register("caps_word_count", "id:i caps_word_count:i", f"SELECT id, {CAPS_DUCK} AS caps_word_count FROM tw", ["tw"])
def q_caps_word_count(spark, sf):
    return view(spark, sf, "tw").select("id", T.caps_word_count("text").alias("caps_word_count"))
