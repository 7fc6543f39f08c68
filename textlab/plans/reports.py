"""Whole reports, for users who ran the reference's analysis scripts: each
returns a dict of named DataFrames (one action per report when collected).

The joined / cleaned input is persisted once and every report reads it, so
the source tables are scanned once however many reports are shown. Call
``unpersist()`` on the returned ``"_base"`` DataFrame when done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import compare as C
from ..operators import profile as P

FEATURES = ["contains_link", "hashtag_count", "caps_word_count", "tweet_length"]


def error_analysis(preds: DataFrame, truth: DataFrame, key: str = "id", target: str = "target",
                   top: int = 10) -> dict[str, DataFrame]:
    """Predictions (key, target) against truth (key, keyword, location, text,
    target): the error table and every error report of the analysis."""
    m = C.with_features(C.pred_actual_join(preds, truth, key, target)).persist()
    errs, right = C.misclassified(m), C.correct(m)
    both = (errs.select(F.lit("misclassified").alias("series"), "tweet_length", "hashtag_count", "caps_word_count")
            .unionByName(m.select(F.lit("all").alias("series"), "tweet_length", "hashtag_count", "caps_word_count")))
    lengths = (errs.select(F.lit("misclassified").alias("series"), "tweet_length")
               .unionByName(right.select(F.lit("correct").alias("series"), "tweet_length")))
    out = {
        "_base": m,
        "misclassified": C.error_table(m, key),
        "misclassification_rate": C.misclassification_rate(m),
        "error_direction": C.error_direction(m),
        "length_by_correctness": C.length_by_correctness(m),
        "length_histogram": P.histogram_equal_width(lengths, "tweet_length", 20, "series"),
        "top_words_misclassified": C.top_words(errs, n=top),
        "top_words_correct": C.top_words(right, n=top),
        "link_share": C.errors_vs_all(m, F.col("contains_link").cast("double"), "share"),
        "hashtag_avg": C.errors_vs_all(m, F.col("hashtag_count"), "avg_hashtags"),
        "hashtag_histogram": P.histogram_int_edges(both, "hashtag_count", range(10), "series"),
        "caps_avg": C.errors_vs_all(m, F.col("caps_word_count"), "avg_caps"),
        "caps_histogram": P.histogram_int_edges(both, "caps_word_count", range(10), "series"),
        "feature_correlation": C.feature_correlation(errs, FEATURES),
    }
    for col in ("keyword", "location"):
        out[f"{col}_top_misclassified"] = C.value_counts(errs, col, top)
        out[f"{col}_top_all"] = C.value_counts(m, col, top)
        out[f"{col}_error_rate"] = C.group_error_rate(m, col, n=top)
    return out


def dataset_profile(train: DataFrame, test: DataFrame, top: int = 20, bins: int = 50) -> dict[str, DataFrame]:
    """Train (id, keyword, location, text, target) and test tables: the
    profile, target distribution, keyword / location counts and missing
    values, length statistics and histogram, and keyword overlap."""
    def clean(df):
        return df.withColumn("keyword", T.keyword_clean("keyword"))

    tr, te = clean(train), clean(test)
    both = (tr.select(F.lit("train").alias("split"), "keyword", "location", "text")
            .unionByName(te.select(F.lit("test").alias("split"), "keyword", "location", "text"))).persist()
    out = {
        "_base": both,
        "profile_train": P.dataset_profile(tr),
        "profile_test": P.dataset_profile(te),
        "target_distribution": P.target_distribution(tr),
        "length_stats": P.length_stats(both, "text", "split"),
        "length_histogram": P.histogram_equal_width(both, T.text_length("text"), bins, "split"),
        "keyword_overlap": P.keyword_overlap(tr, te),
        "keyword_only_test": P.keyword_except(te, tr),
        "keyword_only_train": P.keyword_except(tr, te),
    }
    for split, df in (("train", tr), ("test", te)):
        for col in ("keyword", "location"):
            counted = df.select(T.none_to_null(col).alias(col))
            out[f"{col}_top_{split}"] = C.value_counts(counted, col, top, dropna=False)
            out[f"{col}_missing_{split}"] = P.missing_counts(df, [col])
            out[f"{col}_distinct_{split}"] = P.distinct_values(counted, [col])
    return out


def cluster_labelling(train: DataFrame, test: DataFrame, k: int, seed: int = 0, key: str = "id", vec: str = "vec",
                      target: str = "target", max_iter: int = 20) -> dict[str, DataFrame]:
    """k-means on the training vectors, clusters labelled by majority vote,
    test rows given their nearest cluster's label (the clustering script)."""
    from ..operators import vectors as VX

    _, centroids, assigned = VX.kmeans_fit(train, k, seed, key, vec, max_iter)
    purity = VX.cluster_purity(assigned.join(train.select(key, target), key), "cluster", target)
    pred = VX.cluster_classify(train, test, centroids, key, vec, target)
    return {"centroids": centroids, "purity": purity, "mean_purity": VX.mean_purity(purity),
            "predictions": pred.select(key, F.coalesce("predicted", F.lit(0)).alias(target))}


def knn_labelling(train: DataFrame, test: DataFrame, k: int = 5, key: str = "id", vec: str = "vec",
                  target: str = "target", val: DataFrame | None = None) -> dict[str, DataFrame]:
    """k-nearest-neighbour vote for the test rows, and the validation
    accuracy when a labelled validation set is given (the KNN script)."""
    from ..operators import ensemble as EN
    from ..operators import vectors as VX

    out = {"predictions": VX.knn_classify(test, train, k, key, vec, target)
           .select(key, F.col("predicted").alias(target))}
    if val is not None:
        vp = VX.knn_classify(val, train, k, key, vec, target).join(val.select(key, target), key)
        out["val_accuracy"] = EN.accuracy(vp, "predicted", target)
    return out
