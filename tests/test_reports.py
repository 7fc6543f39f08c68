"""The whole-report entry points agree with the single registered queries."""

from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from textlab.plans import reports as R
from textlab.plans.fixtures import view
from textlab.plans.q_profile import split_col


def _rows(df, ndigits=6):
    return sorted(tuple(round(v, ndigits) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_error_analysis_matches_queries(spark):
    tw = view(spark, SF_SMALL, "tw")
    preds = tw.where("predicted IS NOT NULL").select("id", F.col("predicted").alias("target"))
    truth = tw.where("target IS NOT NULL").select("id", "keyword", "location", "text", "target")
    rep = R.error_analysis(preds, truth)
    try:
        q = E.queries()
        assert _rows(rep["keyword_error_rate"]) == _rows(q["group_error_rate"](spark, SF_SMALL))
        assert _rows(rep["top_words_misclassified"]) == _rows(q["top_words"](spark, SF_SMALL))
        assert _rows(rep["error_direction"]) == _rows(q["error_direction"](spark, SF_SMALL))
        assert _rows(rep["feature_correlation"]) == _rows(q["feature_correlation"](spark, SF_SMALL))
        assert rep["misclassified"].count() == q["error_table"](spark, SF_SMALL).count()
        for name, df in rep.items():
            df.count()  # every report runs
    finally:
        rep["_base"].unpersist()


def test_dataset_profile_report(spark):
    tw = view(spark, SF_SMALL, "tw").withColumn("split", split_col())
    train = tw.where("split = 'train'").drop("split")
    test = tw.where("split = 'test'").drop("split", "target")
    rep = R.dataset_profile(train, test)
    try:
        q = E.queries()
        assert _rows(rep["keyword_overlap"]) == _rows(q["keyword_overlap"](spark, SF_SMALL))
        assert _rows(rep["length_stats"]) == _rows(q["length_stats"](spark, SF_SMALL))
        for name, df in rep.items():
            df.count()
    finally:
        rep["_base"].unpersist()


def test_vector_labelling_reports(spark):
    pts = view(spark, SF_SMALL, "points")
    train, test = pts.where("NOT is_query"), pts.where("is_query")
    rep = R.cluster_labelling(train, test, 5, seed=0)
    assert rep["centroids"].count() == 5
    assert rep["predictions"].count() == test.count()
    assert 0.5 <= rep["mean_purity"].first()[0] <= 1.0
    knn = R.knn_labelling(train, test, 5, val=test)
    assert _rows(knn["predictions"].withColumnRenamed("target", "predicted")) == \
        _rows(E.queries()["knn_classify"](spark, SF_SMALL))
    assert 0.0 <= knn["val_accuracy"].first()[0] <= 1.0
