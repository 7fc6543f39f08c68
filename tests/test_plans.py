"""Physical-plan checks: the shapes the operators promise (top-k as
TakeOrderedAndProject, one exchange for vocabulary encoding, partial top-k
for KNN, broadcast of bounded sides, pushdown and pruning at the scan)."""

import contextlib
import io

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def _tree(df) -> str:
    return _plan(df).split("\n\n(1)")[0]


def test_top_k_is_take_ordered(spark):
    for name in ("group_error_rate", "top_words", "value_counts_top", "head_n"):
        assert "TakeOrderedAndProject" in _tree(E.queries()[name](spark, SF_SMALL)), name


def test_vocab_encode_single_exchange_on_key(spark):
    tree = _tree(E.queries()["vocab_encode"](spark, SF_SMALL))
    # the only non-broadcast exchanges: the vocabulary count, and the one on the row key
    enc_part = tree.split("BroadcastExchange")[0]
    assert enc_part.count("Exchange") == 1
    assert "BroadcastHashJoin LeftOuter" in tree


def test_knn_partial_top_k_and_no_cartesian(spark):
    tree = _tree(E.queries()["knn_classify"](spark, SF_SMALL))
    assert tree.count("WindowGroupLimit") == 2
    assert "FlatMapCoGroupsInPandas" in tree
    assert "Cartesian" not in tree and "BroadcastNestedLoopJoin" not in tree


def test_no_cross_joins_anywhere(spark):
    for name, q in E.queries().items():
        if name in ("cluster_count_sweep", "seed_sweep_ensemble", "mlp_train", "kmeans_fit") or name.startswith("scan_") \
                or name.startswith("write_"):
            continue  # these run jobs while building the plan; covered elsewhere
        tree = _tree(q(spark, SF_SMALL))
        assert "CartesianProduct" not in tree and "BroadcastNestedLoopJoin" not in tree, name


def test_bow_mean_no_shuffle_before_aggregate(spark):
    tree = _tree(E.queries()["bow_mean_vector"](spark, SF_SMALL))
    assert "BroadcastHashJoin LeftOuter" in tree
    assert "ObjectHashAggregate" not in tree  # plain sums, not object buffers


def test_nearest_centroid_no_exchange(spark):
    tree = _tree(E.queries()["nearest_centroid"](spark, SF_SMALL))
    assert "MapInPandas" in tree and "Exchange" not in tree


def test_scan_pruning_and_pushdown(spark):
    plan = _plan(E.queries()["text_length"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
    plan = _plan(E.queries()["cluster_classify"](spark, SF_SMALL))
    # the query points need no label; the training labels need no vectors
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
    assert "ReadSchema: struct<vec_id:bigint,label:int>" in plan
    assert "PushedFilters: [IsNotNull(vec_id)" in plan


def test_bootstrap_no_shuffle_of_rows(spark):
    tree = _tree(E.queries()["balanced_bootstrap"](spark, SF_SMALL))
    assert "Generate" in tree
    # the class table is broadcast; only the labels side of the fixture join may shuffle
    assert tree.count("Exchange") - tree.count("BroadcastExchange") <= 1
