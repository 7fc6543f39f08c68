"""Prediction runs in one long table ``(run, id, score, target)``: thresholds,
ensembles by vote or by mean score, accuracy, loss, per-epoch roll-ups and
F1 reports. Every operator is a grouped aggregation keyed by row id or run;
runs are rows, not files or positional lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RUNS = 100_000  # run-weight tables (one row per run) are broadcast below this


def threshold_label(score, t: float = 0.5, scale: str = "raw") -> Column:
    """Strict ``score > t`` as 0/1.

    ``scale='raw'`` compares the score as it is (the reference also does this
    for raw logits, where 0.5 is not probability 0.5). ``scale='logit'`` reads
    ``t`` as a probability and the score as a logit: sigmoid(score) > t."""
    s = F.col(score) if isinstance(score, str) else score
    if scale == "raw":
        return (s > F.lit(t)).cast("int")
    if scale == "logit":
        import math
        return (s > F.lit(math.log(t / (1 - t)))).cast("int")
    raise ValueError(f"unknown scale {scale!r}")


def vote_ensemble(preds: DataFrame, weights: DataFrame | None = None, key: str = "id", run: str = "run",
                  target: str = "target") -> DataFrame:
    """Weighted mean of 0/1 votes per row, strict > 0.5 (a tie gives 0).
    A run listed twice in the reference is weight 2 here (``weights``:
    run, w). The weight table has one row per run and is broadcast under a
    counted bound."""
    p = preds.select(key, run, target)
    if weights is not None:
        w = weights.select(run, "w")
        p = p.join(F.broadcast(w) if w.count() <= MAX_RUNS else w, run, "inner")
    else:
        p = p.withColumn("w", F.lit(1))
    g = p.groupBy(key).agg(F.try_divide(F.sum(F.col("w") * F.col(target)).cast("double"), F.sum("w")).alias("vote"))
    return g.select(key, "vote", (F.col("vote") > 0.5).cast("int").alias(target))


def score_ensemble(preds: DataFrame, key: str = "id", score: str = "score", t: float = 0.5,
                   target: str = "target") -> DataFrame:
    """Mean score over runs per row, then strict ``> t``."""
    g = preds.groupBy(key).agg(F.avg(score).alias("mean_score"))
    return g.select(key, "mean_score", (F.col("mean_score") > F.lit(t)).cast("int").alias(target))


def accuracy(df: DataFrame, pred: str, actual: str, by=None) -> DataFrame:
    """Share of rows with pred == actual (per group if ``by``)."""
    a = F.avg((F.col(pred) == F.col(actual)).cast("double")).alias("accuracy")
    return df.groupBy(by).agg(a) if by is not None else df.agg(a)


def bce_terms(x: str, y: str, from_logits: bool = True) -> Column:
    """Per-row binary cross-entropy. From logits in the stable form
    max(x,0) - x*y + log1p(exp(-|x|)); from probabilities with each log
    clamped at -100 (the torch convention)."""
    xc, yc = F.col(x).cast("double"), F.col(y).cast("double")
    if from_logits:
        return F.greatest(xc, F.lit(0.0)) - xc * yc + F.log1p(F.exp(-F.abs(xc)))
    lp = F.greatest(F.when(xc > 0, F.ln(xc)), F.lit(-100.0))
    lq = F.greatest(F.when(xc < 1, F.ln(F.lit(1.0) - xc)), F.lit(-100.0))
    # `greatest` skips nulls, so rows without score or target are left out explicitly
    return F.when(xc.isNotNull() & yc.isNotNull(), -(yc * lp + (F.lit(1.0) - yc) * lq))


def bce_loss(df: DataFrame, score: str, target: str, by=None) -> DataFrame:
    """Mean BCE both ways (score read as a logit, and as a probability)."""
    aggs = [F.avg(bce_terms(score, target, True)).alias("bce_logit"),
            F.avg(bce_terms(score, target, False)).alias("bce_prob")]
    return df.groupBy(by).agg(*aggs) if by is not None else df.agg(*aggs)


def runlog_rollup(log: DataFrame, run: str = "run", epoch: str = "epoch", batch: str = "batch", n: str = "n",
                  correct: str = "correct", loss: str = "loss") -> DataFrame:
    """Per (run, epoch): mean batch loss, epoch accuracy sum(correct) /
    sum(n), mean of batch accuracies (the MLP script's variant) and the batch
    accuracy at the epoch's last batch (max_by, no window)."""
    bacc = F.try_divide(F.col(correct), F.col(n))  # an empty batch has no accuracy
    return (log.groupBy(run, epoch)
            .agg(F.avg(loss).alias("mean_loss"),
                 F.try_divide(F.sum(correct), F.sum(n)).alias("accuracy"),
                 F.avg(bacc).alias("mean_batch_acc"),
                 F.max_by(bacc, F.col(batch)).alias("last_batch_acc")))


def f1_report(df: DataFrame, pred: str, actual: str, run: str = "run") -> DataFrame:
    """Per run tp/fp/fn/tn, precision, recall and F1 (positive class 1),
    best F1 first (ties by run). One grouped pass of conditional counts."""
    p, a = F.col(pred), F.col(actual)
    g = df.groupBy(run).agg(F.count_if((p == 1) & (a == 1)).alias("tp"), F.count_if((p == 1) & (a == 0)).alias("fp"),
                            F.count_if((p == 0) & (a == 1)).alias("fn"), F.count_if((p == 0) & (a == 0)).alias("tn"))
    prec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fp"))
    rec = F.try_divide(F.col("tp").cast("double"), F.col("tp") + F.col("fn"))
    f1 = F.try_divide(F.lit(2.0) * F.col("tp"), F.lit(2) * F.col("tp") + F.col("fp") + F.col("fn"))
    return (g.select(run, "tp", "fp", "fn", "tn", prec.alias("precision"), rec.alias("recall"), f1.alias("f1"))
            .orderBy(F.col("f1").desc_nulls_last(), F.col(run)))


def argmax_setting(df: DataFrame, setting: str, metric: str) -> DataFrame:
    """The setting with the highest metric, the first setting on ties."""
    return df.orderBy(F.col(metric).desc_nulls_last(), F.col(setting).asc()).limit(1)
