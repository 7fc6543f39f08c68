"""The row-wise and keyed operators on Structured Streaming.

The reference has no streaming part; these helpers only show that the same
operators run unchanged on a streaming DataFrame: row-wise features and the
stream-static join of predictions to truth are stateless, and the per-group
error counts are a stateful aggregation (update / complete output mode).
Sort, set operations, k-means, KNN and the vocabulary are batch only.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import compare as C
from ..session import shared_dir


def read_prediction_stream(spark: SparkSession, path: str, schema: str, max_files_per_trigger: int = 100) -> DataFrame:
    """Prediction rows arriving as parquet files in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)


def errors_with_features(preds: DataFrame, truth: DataFrame, key: str = "id", target: str = "target") -> DataFrame:
    """Stream-static J1 + error flag + text features (stateless)."""
    m = C.pred_actual_join(preds, truth, key, target)
    return C.with_features(m).withColumn("is_error", C.error_flag())


def running_error_counts(m: DataFrame, group: str) -> DataFrame:
    """Stateful per-group error counts and rate (A9 without the top-k, which a
    stream cannot keep); emit with output mode 'update' or 'complete'."""
    g = (m.where(F.col(group).isNotNull()).groupBy(group)
         .agg(F.count_if(C.error_flag()).alias("n_err"), F.count(F.lit(1)).alias("n")))
    return g.withColumn("rate", F.col("n_err") / F.col("n"))


def start_to_parquet(df: DataFrame, path: str, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Append a stateless stream to parquet. Unless given, the checkpoint is a
    folder below the shared one that belongs to ``path``, so a restarted query
    goes on behind what it has written there and appends nothing twice."""
    own = hashlib.sha256(path.rstrip("/").encode()).hexdigest()[:32]
    ckpt = checkpoint or os.path.join(shared_dir(df.sparkSession), f"textlab-stream-{own}")
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", ckpt).outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()
