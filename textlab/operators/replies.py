"""A store of replies to prompts: each distinct prompt is asked once, ever.

The store is a folder of Parquet tables, one per round: (key, reply, error), key
the SHA-256 of the prompt. Prompts without a stored reply are found by an
anti-join of the distinct prompts, and asked in rounds of at most
``ROUND_CALLS``; a round is written as a whole when its tasks are done (a folder counts by its
``_SUCCESS`` file), so a driver lost at any time loses one round. Within a round
the user's function gets batches of prompts, in ``tasks`` tasks that share the
allowed calls per second. A call that raises is stored as an error with no reply: the
others of its round are kept, and the next call of :func:`ask_missing` asks it again.

A task that Spark repeats after losing an executor asks its part of the round again,
as no one else knows its replies; the store still holds one reply a prompt.
Null prompts are not asked and have no reply. Rows with equal prompts share one.
"""

from __future__ import annotations

import math
import time
from typing import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import list_paths, scratch_path, stage_table

ROUND_CALLS = 100_000
STORED = "key string, reply string, error string"


def stored_replies(spark: SparkSession, store: str) -> DataFrame:
    """(key, reply) of all whole rounds; one row per prompt that has a reply."""
    rounds = [p for p in list_paths(spark, store) if "/round-" in p and list_paths(spark, f"{p}/_SUCCESS")]
    if not rounds:
        return spark.createDataFrame([], "key string, reply string")
    rows = spark.read.schema(STORED).parquet(*rounds).where("reply is not null")
    return rows.groupBy("key").agg(F.min("reply").alias("reply"))


def _ask_batches(ask, per_second: float | None, batch: int):
    def run(batches):
        due = time.monotonic()
        for b in batches:
            keys, prompts = b.column("key").to_pylist(), b.column("prompt").to_pylist()
            for at in range(0, len(keys), batch):
                some = prompts[at: at + batch]
                if per_second:
                    time.sleep(max(0.0, due - time.monotonic()))
                    due = max(due, time.monotonic()) + len(some) / per_second
                replies, errors = _asked(ask, some)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at: at + batch], pa.string()), pa.array(replies, pa.string()),
                                                  pa.array(errors, pa.string())], ["key", "reply", "error"])
    return run


def _asked(ask, prompts: list[str]) -> tuple[list, list]:
    """Replies and errors of a batch; a batch that fails is asked one by one, so that one prompt spoils no other."""
    try:
        replies = list(ask(prompts))
        if len(replies) != len(prompts):
            raise ValueError(f"{len(replies)} replies to {len(prompts)} prompts")
        return replies, [None] * len(prompts)
    except Exception as e:
        if len(prompts) == 1:
            return [None], [f"{type(e).__name__}: {e}"[:500]]
    parts = [_asked(ask, [p]) for p in prompts]
    return [r for r, _ in parts for r in r], [e for _, e in parts for e in e]


def ask_missing(prompts: DataFrame, store: str, ask: Callable[[list[str]], list[str]], prompt: str = "prompt", tasks: int = 4,
                per_second: float | None = None, batch: int = 16, round_calls: int = ROUND_CALLS) -> int:
    """Asks every distinct prompt that has no reply in ``store``; returns how many were asked."""
    spark = prompts.sparkSession
    distinct = prompts.where(F.col(prompt).isNotNull()).select(F.col(prompt).cast("string").alias("prompt")).distinct().withColumn(
        "key", F.sha2("prompt", 256))
    missing = stage_table(distinct.join(stored_replies(spark, store).select("key"), "key", "left_anti"), "prompts")
    n = missing.count()
    rounds = math.ceil(n / round_calls)
    for r in range(rounds):
        own = missing if rounds == 1 else missing.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == r)
        share = None if per_second is None else per_second / tasks
        name = scratch_path(spark, "round").rsplit("-", 1)[1]
        own.repartition(tasks, "key").select("key", "prompt").mapInArrow(_ask_batches(ask, share, batch), STORED).write.parquet(
            f"{store.rstrip('/')}/round-{name}")
    return n


def attach_replies(rows: DataFrame, store: str, prompt: str = "prompt", out: str = "reply") -> DataFrame:
    """``rows`` with the stored reply to their prompt (null: none yet)."""
    have = stored_replies(rows.sparkSession, store).select(F.col("key").alias("__key"), F.col("reply").alias(out))
    return rows.join(have, F.sha2(F.col(prompt).cast("string"), 256) == F.col("__key"), "left").drop("__key")


def failed_prompts(spark: SparkSession, store: str) -> DataFrame:
    """(key, error) of prompts whose calls failed and that have no reply yet, with their last error."""
    rounds = [p for p in list_paths(spark, store) if "/round-" in p and list_paths(spark, f"{p}/_SUCCESS")]
    if not rounds:
        return spark.createDataFrame([], "key string, error string")
    rows = spark.read.schema(STORED).parquet(*rounds).select("*", F.col("_metadata.file_modification_time").alias("at"))
    last = Window.partitionBy("key").orderBy(F.col("reply").isNotNull().desc(), F.col("at").desc(), "error")
    return rows.withColumn("n", F.row_number().over(last)).where("n = 1 and reply is null").select("key", "error")
