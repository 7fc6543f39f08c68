"""Registered queries: sources and sinks as write / read-back round trips
(S1-S6) under the shared checkpoint folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare as C
from ..session import scratch_path
from ..sources import csv_io as IO
from ..sources import word2vec as W2
from .fixtures import view
from .q_compare import M_CTE, merged
from .q_prepare import DIM
from .registry import register


@register("scan_labelled_csv", "text:s target:i", "SELECT text, target FROM tw WHERE target IS NOT NULL", ["tw"])
def q_scan_labelled(spark, sf):
    path = scratch_path(spark, "labelled")
    tw = view(spark, sf, "tw").where(F.col("target").isNotNull()).select("id", "keyword", "location", "text", "target")
    IO.write_csv(tw, path)
    return IO.read_labelled(spark, path)


@register("scan_unlabelled_csv", "text:s id:i", "SELECT text, id FROM tw WHERE target IS NULL", ["tw"])
def q_scan_unlabelled(spark, sf):
    path = scratch_path(spark, "unlabelled")
    tw = view(spark, sf, "tw").where(F.col("target").isNull()).select("id", "keyword", "location", "text")
    IO.write_csv(tw, path)
    return IO.read_unlabelled(spark, path)


@register("scan_prediction_runs", "run:s id:i target:i",
          "SELECT p.run, p.id, p.target FROM preds p JOIN run_weights w ON p.run = w.run, "
          "range(0, 5) AS r(i) WHERE r.i < w.w", ["preds", "run_weights"])
def q_scan_runs(spark, sf):
    root = scratch_path(spark, "runs")
    preds = view(spark, sf, "preds")
    # one folder per run: run_name() reads the folder name back
    preds.select("run", "id", "target").write.mode("overwrite").partitionBy("run") \
        .options(**IO._WRITE_OPTS).csv(root)
    runs = sorted(r[0] for r in preds.select("run").distinct().collect())  # a handful of run names
    paths = []
    for r in runs:
        paths.append(f"{root}/run={r}")
        if r == "run3":  # the run listed twice
            paths.append(f"{root}/run={r}")
    df = IO.read_prediction_runs(spark, paths)
    return df.withColumn("run", F.regexp_replace("run", "^run=", ""))


@register("scan_word_vectors", "tok:s dim:i value:d",
          "SELECT tok, unnest(generate_series(0, len(vec) - 1)) AS dim, unnest(vec) AS value FROM word_vectors",
          ["word_vectors"])
def q_scan_word_vectors(spark, sf):
    path = scratch_path(spark, "vectors")
    IO.write_word_vectors(view(spark, sf, "word_vectors"), path)
    wv = IO.read_word_vectors(spark, path, DIM)
    return wv.select("tok", F.posexplode("vec").alias("dim", "value"))


@register("scan_word_vectors_binary", "tok:s dim:i value:d",
          "SELECT tok, unnest(generate_series(0, len(vec) - 1)) AS dim, unnest(vec) AS value FROM word_vectors",
          ["word_vectors"])
def q_scan_word_vectors_binary(spark, sf):
    path = scratch_path(spark, "binary-vectors")
    W2.write_binary_vectors(view(spark, sf, "word_vectors"), path)
    wv = W2.read_binary_vectors(spark, path, split_bytes=4 << 20)
    return wv.select("tok", F.posexplode("vec").alias("dim", "value"))


@register("write_predictions", "id:i target:i", "SELECT id, target FROM preds WHERE run = 'run0'", ["preds"])
def q_write_predictions(spark, sf):
    path = scratch_path(spark, "predictions")
    IO.write_predictions(view(spark, sf, "preds").where(F.col("run") == "run0"), path)
    return IO.read_csv(spark, path, IO.PREDICTION_SCHEMA)


@register("write_misclassified", "id:i keyword:s location:s text:s actual_target:i predicted_target:i",
          f"WITH {M_CTE} SELECT id, keyword, location, text, actual_target, predicted_target FROM m "
          "WHERE predicted_target <> actual_target", ["tw"])
def q_write_misclassified(spark, sf):
    path = scratch_path(spark, "misclassified")
    IO.write_misclassified(C.error_table(merged(spark, sf)), path)
    return IO.read_csv(spark, path, "id LONG, keyword STRING, location STRING, text STRING, "
                                    "actual_target INT, predicted_target INT")
