"""Operators on hand-made tables: the edge cases named in SURVEY §2 and §5
(ties, empty text, all-null group, constant column, value 9 in the integer
histogram, no known token, duplicate run), with numpy / Counter oracles."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators import compare as C
from textlab.operators import ensemble as EN
from textlab.operators import profile as P
from textlab.operators import prompts as PR
from textlab.operators import sample as S
from textlab.operators import vocab as V


@pytest.fixture(scope="module")
def merged(spark):
    rows = [(1, "a", "x", "Fire NEAR http://t.co #a", 1, 1), (2, "a", None, "calm day", 0, 1),
            (3, "b", "y", "ALL OK #x #y", 1, 0), (4, None, "y", "", 0, 0), (5, "b", "x", "b b b", 1, 1),
            (6, "c", None, "c", 0, 1)]
    return spark.createDataFrame(rows, "id LONG, keyword STRING, location STRING, text STRING, "
                                       "predicted_target INT, actual_target INT")


def test_group_error_rate_ties_and_nulls(merged):
    out = [tuple(r) for r in C.group_error_rate(merged, "keyword").collect()]
    # a: 1 error of 2, b: 1 of 2, c: 1 of 1; null keyword dropped; ties by key
    assert out == [("c", 1, 1, 1.0), ("a", 1, 2, 0.5), ("b", 1, 2, 0.5)]
    assert [r[0] for r in C.group_error_rate(merged, "keyword", min_count=2).collect()] == ["a", "b"]


def test_error_direction_and_rate(merged):
    r = C.error_direction(merged).first()
    assert (r.false_positives, r.false_negatives) == (1, 2)
    m = C.misclassification_rate(merged).first()
    assert (m.n_rows, m.n_errors) == (6, 3) and m.rate == 0.5


def test_rate_align_absent_numerator_is_zero(spark):
    num = spark.createDataFrame([("a", 1)], "k STRING, n_err LONG")
    den = spark.createDataFrame([("a", 2), ("b", 4)], "k STRING, n LONG")
    got = {r.k: r.rate for r in C.rate_align(num, den, "k").collect()}
    assert got == {"a": 0.5, "b": 0.0}


def test_feature_correlation_constant_column_is_null(spark):
    d = spark.createDataFrame([(1.0, 2.0, 5.0), (2.0, 4.1, 5.0), (3.0, 5.9, 5.0)], "a DOUBLE, b DOUBLE, c DOUBLE")
    got = {(r.a, r.b): r.r for r in C.feature_correlation(d, ["a", "b", "c"]).collect()}
    want = np.corrcoef([[1, 2, 3], [2, 4.1, 5.9]])
    assert math.isclose(got[("a", "b")], want[0, 1], rel_tol=1e-12)
    assert math.isclose(got[("a", "a")], 1.0, rel_tol=1e-12)
    assert got[("a", "c")] is None and got[("c", "c")] is None


def test_top_words_matches_counter(merged):
    texts = [r.text for r in merged.collect()]
    cnt = Counter(w for t in texts for w in t.lower().split())
    want = sorted(cnt.items(), key=lambda kv: (-kv[1], kv[0]))[:3]
    assert [tuple(r) for r in C.top_words(merged, n=3).collect()] == want


def test_errors_vs_all(merged):
    got = {r.grp: r.share for r in C.link_share(merged).collect()}
    assert got == {"errors": 0.0, "all": 1 / 6}
    got = {r.grp: r.avg_hashtags for r in C.hashtag_avg(merged).collect()}
    assert got["errors"] == pytest.approx(2 / 3) and got["all"] == pytest.approx(3 / 6)


def test_histogram_equal_width_matches_numpy(spark):
    xs = [1.0, 2.0, 2.0, 3.5, 7.0, 10.0, 10.0]
    d = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    got = [r.n for r in P.histogram_equal_width(d, "x", 5).orderBy("bin").collect()]
    assert got == list(np.histogram(xs, bins=5)[0])
    const = spark.createDataFrame([(4.0,), (4.0,)], "x DOUBLE")  # min == max: numpy widens by 0.5
    got = P.histogram_equal_width(const, "x", 4).orderBy("bin").collect()
    counts, edges = np.histogram([4.0, 4.0], bins=4)
    assert [r.n for r in got] == list(counts)
    assert [r.lo for r in got] == pytest.approx(list(edges[:-1]))


def test_histogram_shared_edges(spark):
    d = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 9.0), ("b", 10.0)], "s STRING, x DOUBLE")
    got = P.histogram_equal_width(d, "x", 2, "s", shared_edges=True).orderBy("series", "bin").collect()
    assert [(r.series, r.bin, r.n) for r in got] == [("a", 0, 2), ("a", 1, 0), ("b", 0, 0), ("b", 1, 2)]


def test_histogram_int_edges_value_nine_and_out_of_range(spark):
    xs = [0, 1, 1, 8, 9, 10, 12]
    d = spark.createDataFrame([(x,) for x in xs], "x INT")
    got = [r.n for r in P.histogram_int_edges(d, "x").orderBy("bin").collect()]
    assert got == list(np.histogram(xs, bins=range(0, 10))[0])


def test_missing_distinct_profile(spark):
    d = spark.createDataFrame([(1, "None", None), (2, "a", "x"), (3, None, "x")], "id INT, k STRING, l STRING")
    got = {r.column: (r.none_count, r.null_count, r.total_missing) for r in P.missing_counts(d, ["k", "l"]).collect()}
    assert got == {"k": (1, 1, 2), "l": (0, 1, 1)}
    got = {r.column: r.n_distinct for r in P.distinct_values(d, ["k", "l"]).collect()}
    assert got == {"k": 2, "l": 1}
    prof = {r.column: (r.dtype, r.non_null, r.n_distinct, r.n_rows, r.n_cols) for r in P.dataset_profile(d).collect()}
    assert prof["k"] == ("string", 2, 2, 3, 3) and prof["id"] == ("int", 3, 3, 3, 3)


def test_set_overlap(spark):
    a = spark.createDataFrame([("x",), ("y",), ("y",), (None,)], "keyword STRING")
    b = spark.createDataFrame([("y",), ("z",)], "keyword STRING")
    o = P.keyword_overlap(a, b).first()
    assert (o.n_a, o.n_b, o.n_common) == (2, 2, 1) and o.pct_a_in_b == 50.0
    assert [r[0] for r in P.keyword_intersect(a, b).collect()] == ["y"]
    assert [r[0] for r in P.keyword_except(a, b).collect()] == ["x"]


def test_vote_ensemble_tie_and_double_weight(spark):
    preds = spark.createDataFrame([("r0", 1, 1), ("r1", 1, 0), ("r0", 2, 1), ("r1", 2, 0)], "run STRING, id INT, target INT")
    assert {r.id: r.target for r in EN.vote_ensemble(preds).collect()} == {1: 0, 2: 0}  # 0.5 is not > 0.5
    w = spark.createDataFrame([("r0", 2), ("r1", 1)], "run STRING, w INT")
    assert {r.id: r.target for r in EN.vote_ensemble(preds, w).collect()} == {1: 1, 2: 1}


def test_threshold_scales(spark):
    d = spark.createDataFrame([(0.4,), (0.5,), (0.6,), (-0.1,)], "s DOUBLE")
    assert [r[0] for r in d.select(EN.threshold_label("s", 0.5)).collect()] == [0, 0, 1, 0]
    assert [r[0] for r in d.select(EN.threshold_label("s", 0.5, "logit")).collect()] == [1, 1, 1, 0]


def test_bce_matches_numpy(spark):
    xs, ys = [-2.0, 0.0, 3.0, 0.999999], [0, 1, 1, 0]
    d = spark.createDataFrame(list(zip(xs, ys)), "x DOUBLE, y INT")
    r = EN.bce_loss(d, "x", "y").first()
    x, y = np.array(xs), np.array(ys)
    logit = np.mean(np.maximum(x, 0) - x * y + np.log1p(np.exp(-np.abs(x))))
    p = x
    lp = np.where(p > 0, np.log(np.where(p > 0, p, 1)), -100).clip(-100)
    lq = np.where(p < 1, np.log(np.where(p < 1, 1 - p, 1)), -100).clip(-100)
    prob = np.mean(-(y * lp + (1 - y) * lq))
    assert r.bce_logit == pytest.approx(logit) and r.bce_prob == pytest.approx(prob)


def test_f1_report(spark):
    d = spark.createDataFrame([("a", 1, 1), ("a", 1, 0), ("a", 0, 1), ("a", 0, 0), ("b", 0, 1)],
                              "run STRING, p INT, y INT")
    rows = EN.f1_report(d, "p", "y").collect()
    assert [r.run for r in rows] == ["a", "b"]
    a = rows[0]
    assert (a.tp, a.fp, a.fn, a.tn) == (1, 1, 1, 1) and a.f1 == 0.5
    assert rows[1].precision is None and rows[1].f1 == 0.0


def test_runlog_rollup(spark):
    d = spark.createDataFrame([("r", 1, 1, 10, 5, 1.0), ("r", 1, 2, 10, 10, 3.0)],
                              "run STRING, epoch INT, batch INT, n INT, correct INT, loss DOUBLE")
    r = EN.runlog_rollup(d).first()
    assert (r.mean_loss, r.accuracy, r.mean_batch_acc, r.last_batch_acc) == (2.0, 0.75, 0.75, 1.0)


def test_class_weights_and_bootstrap(spark):
    d = spark.createDataFrame([(i, 1 if i < 100 else 0) for i in range(1000)], "id INT, target INT")
    w = {r.target: r.weight for r in S.class_weights(d).collect()}
    assert w == {1: 1000 / (2 * 100), 0: 1000 / (2 * 900)}
    boot = S.balanced_bootstrap(d, seed=3)
    n = boot.count()
    per = {r.target: r["count"] for r in boot.groupBy("target").count().collect()}
    assert 850 < n < 1150 and abs(per[1] - per[0]) < 150  # balanced in expectation
    assert boot.count() == n  # deterministic on recomputation


def test_splits(spark):
    d = spark.range(1000).withColumnRenamed("id", "id")
    a = {r.id for r in S.train_val_split(d, 0.2, 7).where("is_val").collect()}
    b = {r.id for r in S.train_val_split(d.repartition(5), 0.2, 7).where("is_val").collect()}
    assert a == b and 150 < len(a) < 250
    ex = S.train_val_split_exact(d, 0.2, 7)
    assert ex.where("is_val").count() == math.ceil(0.2 * 1000)


def test_vocab_encode_edges(spark):
    d = spark.createDataFrame([(1, "a b a <UNK> c"), (2, ""), (3, " ".join(["a"] * 200))], "id INT, text STRING")
    voc = V.build_vocab(d, max_size=4)
    assert {r.tok: r.idx for r in voc.collect()} == {"<PAD>": 0, "<UNK>": 1, "a": 2, "b": 3}
    enc = {r.id: r.input_ids for r in V.vocab_encode(d, voc, max_len=6).collect()}
    assert enc == {1: [2, 3, 2, 1, 1, 0], 2: [0] * 6, 3: [2] * 6}


def test_bow_mean_and_masked_pool(spark):
    wv = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0])], "tok STRING, vec ARRAY<FLOAT>")
    d = spark.createDataFrame([(1, "a a b zz"), (2, "zz"), (3, "")], "id INT, text STRING")
    for how in (None, True, False):  # size-checked default, broadcast path, shuffle-join path
        got = {r.id: r.vec for r in V.bow_mean_vector(d, wv, 2, broadcast_vectors=how).collect()}
        assert got[1] == pytest.approx([2 / 3, 2 / 3]) and got[2] == [0.0, 0.0] and got[3] == [0.0, 0.0]
    h = spark.createDataFrame([(1, 0, 1, [1.0, 1.0]), (1, 1, 1, [3.0, 5.0]), (1, 2, 0, [9.0, 9.0]),
                               (2, 0, 0, [1.0, 1.0])], "id INT, pos INT, mask INT, vec ARRAY<FLOAT>")
    got = {r.id: r.vec for r in V.masked_mean_pool(h).collect()}
    assert got == {1: [2.0, 3.0], 2: None}


def test_vocab_vectors_known_and_random(spark):
    voc = spark.createDataFrame([("<PAD>", 0), ("<UNK>", 1), ("a", 2)], "tok STRING, idx INT")
    wv = spark.createDataFrame([("a", [0.5, -0.5, 0.25])], "tok STRING, vec ARRAY<FLOAT>")
    got = {r.idx: r.vec for r in V.vocab_vectors(voc, wv, 3, seed=1).collect()}
    assert got[2] == [0.5, -0.5, 0.25]
    assert all(-0.25 <= x < 0.25 for x in got[0] + got[1]) and got[0] != got[1]
    again = {r.idx: r.vec for r in V.vocab_vectors(voc, wv, 3, seed=1).collect()}
    assert again == got


def test_prompts(spark):
    train = spark.createDataFrame([(i, f"t{i} [test_tweet]" if i == 0 else f"t{i}", i % 2) for i in range(30)],
                                  "id INT, text STRING, target INT")
    ex = PR.few_shot_select(train, 10)
    assert [(r.slot, r.id) for r in ex.orderBy("slot").collect()] == list(enumerate([0, 1, 2, 3, 4, 20, 21, 22, 23, 24]))
    rows = spark.createDataFrame([(100, "hello")], "id INT, text STRING")
    got = PR.prompt_build(rows, 1, PR.few_shot_select(train, 1)).first().prompt
    # the example text is filled first, so its own [test_tweet] is replaced too (reference order)
    want = PR.ONE_SHOT_TEMPLATE.replace("[example_tweet]", "t0 [test_tweet]").replace("[desaster]", "0")
    assert got == want.replace("[test_tweet]", "hello")
    with pytest.raises(ValueError):
        PR.fill_template(5, [])


def test_metamorphic_repartition(spark, merged):
    a = sorted(tuple(r) for r in C.group_error_rate(merged, "keyword", n=None).collect())
    b = sorted(tuple(r) for r in C.group_error_rate(merged.repartition(3).orderBy(F.rand(1)), "keyword", n=None).collect())
    assert a == b


def test_bootstrap_rare_class_window(spark):
    # one positive in 1000 rows: weight 500, the CDF table starts above 0
    lo, hi = S.poisson_window(500.0)
    assert lo > 0 and S.poisson_counts(500.0, np.array([1 - 1e-12]))[0] <= hi
    d = spark.createDataFrame([(i, 1 if i == 7 else 0) for i in range(1000)], "id INT, target INT")
    k = S.balanced_bootstrap(d, seed=1).where("target = 1").count()
    assert 500 - 12 * 500 ** 0.5 < k < 500 + 12 * 500 ** 0.5
