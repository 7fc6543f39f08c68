"""Metamorphic checks: results do not depend on how the work is cut.
The same queries under another shuffle-partition count with AQE off (so no
runtime broadcast or coalescing either) must give the same rows."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

NAMES = ["group_error_rate", "top_words", "vocab_encode", "bow_mean_vector", "knn_k_sweep", "nearest_centroid",
         "histogram_equal_width", "train_val_split_exact", "balanced_bootstrap", "vote_ensemble", "build_vocab",
         "keyword_overlap", "f1_report", "masked_mean_pool"]


@pytest.mark.parametrize("name", NAMES)
def test_same_rows_under_other_partitioning(spark, name):
    q = E.queries()[name]
    base = sorted(map(tuple, q(spark, SF_SMALL).collect()))
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled",
                                          "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        other = sorted(map(tuple, q(spark, SF_SMALL).collect()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert base == other
