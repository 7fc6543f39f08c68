"""Registered queries: prediction runs and ensembles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble as EN
from .fixtures import table, view
from .registry import register

PA = ("pa AS (SELECT p.run, p.id, p.score, p.target AS predicted, l.quality AS actual "
      "FROM preds p JOIN labels l ON p.id = l.doc_id)")


def preds_actual(spark, sf):
    truth = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("actual"))
    return view(spark, sf, "preds").withColumnRenamed("target", "predicted").join(truth, "id")


@register("threshold_label", "run:s id:i target:i",
          "SELECT run, id, CAST(score > 0.5 AS INT) AS target FROM preds", ["preds"])
def q_threshold(spark, sf):
    return view(spark, sf, "preds").select("run", "id", EN.threshold_label("score", 0.5).alias("target"))


@register("vote_ensemble", "id:i vote:d target:i",
          "SELECT p.id, CAST(sum(w.w * p.target) AS DOUBLE) / sum(w.w) AS vote, "
          "CAST(CAST(sum(w.w * p.target) AS DOUBLE) / sum(w.w) > 0.5 AS INT) AS target "
          "FROM preds p JOIN run_weights w ON p.run = w.run GROUP BY p.id", ["preds", "run_weights"])
def q_vote(spark, sf):
    return EN.vote_ensemble(view(spark, sf, "preds"), view(spark, sf, "run_weights"))


@register("score_ensemble", "id:i mean_score:d target:i",
          "SELECT id, avg(score) AS mean_score, CAST(avg(score) > 0.5 AS INT) AS target FROM preds GROUP BY id",
          ["preds"])
def q_score_ensemble(spark, sf):
    return EN.score_ensemble(view(spark, sf, "preds"))


@register("accuracy", "run:s accuracy:d",
          f"WITH {PA} SELECT run, avg(CAST(predicted = actual AS DOUBLE)) AS accuracy FROM pa GROUP BY run", ["preds"])
def q_accuracy(spark, sf):
    return EN.accuracy(preds_actual(spark, sf), "predicted", "actual", "run")


@register("bce_loss", "run:s bce_logit:d bce_prob:d",
          f"""WITH {PA} SELECT run,
 avg(greatest(score, 0.0) - score * actual + ln(1 + exp(-abs(score)))) AS bce_logit,
 avg(-(actual * (CASE WHEN score > 0 THEN greatest(ln(score), -100.0) ELSE -100.0 END)
      + (1 - actual) * (CASE WHEN score < 1 THEN greatest(ln(1 - score), -100.0) ELSE -100.0 END))) AS bce_prob
FROM pa GROUP BY run""", ["preds"])
def q_bce(spark, sf):
    return EN.bce_loss(preds_actual(spark, sf), "score", "actual", "run")


@register("runlog_rollup", "run:s epoch:i mean_loss:d accuracy:d mean_batch_acc:d last_batch_acc:d",
          "SELECT run, epoch, avg(loss) AS mean_loss, CAST(sum(correct) AS DOUBLE) / sum(n) AS accuracy, "
          "avg(CAST(correct AS DOUBLE) / n) AS mean_batch_acc, arg_max(CAST(correct AS DOUBLE) / n, batch) AS last_batch_acc "
          "FROM runlog GROUP BY run, epoch", ["runlog"])
def q_runlog(spark, sf):
    return EN.runlog_rollup(view(spark, sf, "runlog"))


@register("f1_report", "run:s tp:i fp:i fn:i tn:i precision:d recall:d f1:d",
          f"""WITH {PA}, c AS (SELECT run, count(*) FILTER (WHERE predicted = 1 AND actual = 1) AS tp,
 count(*) FILTER (WHERE predicted = 1 AND actual = 0) AS fp, count(*) FILTER (WHERE predicted = 0 AND actual = 1) AS fn,
 count(*) FILTER (WHERE predicted = 0 AND actual = 0) AS tn FROM pa GROUP BY run)
SELECT run, tp, fp, fn, tn, CAST(tp AS DOUBLE) / nullif(tp + fp, 0) AS precision, CAST(tp AS DOUBLE) / nullif(tp + fn, 0) AS recall,
 2.0 * tp / nullif(2 * tp + fp + fn, 0) AS f1 FROM c ORDER BY f1 DESC, run""", ["preds"])
def q_f1(spark, sf):
    return EN.f1_report(preds_actual(spark, sf), "predicted", "actual")


@register("argmax_setting", "run:s accuracy:d",
          f"WITH {PA} SELECT run, avg(CAST(predicted = actual AS DOUBLE)) AS accuracy FROM pa GROUP BY run "
          "ORDER BY accuracy DESC, run LIMIT 1", ["preds"])
def q_argmax(spark, sf):
    return EN.argmax_setting(EN.accuracy(preds_actual(spark, sf), "predicted", "actual", "run"), "run", "accuracy")
