"""Spark session helpers and the shared scratch location.

The library never picks a machine-local folder on its own when running on a
cluster: anything written (CSV round trips, per-run score tables, lineage cuts)
goes below the folder the cluster names in ``spark.checkpoint.dir``. Only when
that setting is unset (local tests) does :func:`shared_dir` create one.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "textlab",
                  extra: dict | None = None) -> SparkSession:
    """Session with the settings every operator here assumes.

    AQE is on so joins re-plan on runtime sizes (broadcast when a side turns
    out small, skew-join splitting for hot keys, partition coalescing).
    """
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "16g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _one_process(master: str) -> bool:
    """True for ``local`` and ``local[...]``; ``local-cluster[...]`` starts separate executors."""
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The cluster-wide checkpoint folder from the session. Only in one-process
    local mode with nothing set is a local folder created (tests); it is
    removed when Python ends."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not _one_process(sc.master):
                # a driver-local folder is invisible to executors on other machines
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            d = tempfile.mkdtemp(prefix="textlab-ckpt-")
            atexit.register(shutil.rmtree, d, ignore_errors=True)
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh, unique path below the shared folder; :func:`drop_path` removes it."""
    return os.path.join(shared_dir(spark), f"textlab-{what}-{uuid.uuid4().hex}")


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch path of this library through Spark's file systems."""
    if "/textlab-" not in path:
        raise ValueError(f"not a scratch path of this library: {path}")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def list_paths(spark: SparkSession, path: str) -> list[str]:
    """What lies in a folder (a file: itself), through Spark's file systems; nothing where there is no such path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().toString() for s in fs.listStatus(p)] if fs.exists(p) else []


def stage_table(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` as parquet below the shared folder and read it back: cuts
    the lineage and survives the loss of executors."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


BATCH_BYTES = 2 << 20


@contextmanager
def small_batches(spark: SparkSession):
    """Python passes that run inside (written or collected there) get their rows in Arrow batches of about
    ``BATCH_BYTES``. Spark's own bound is 64 MB, which the JVM holds once or twice and a worker two or three
    times (Arrow, Python objects, the batch before) for every running task. Only how rows are cut into batches changes."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def without_summary(model):
    """A fitted Spark ML classifier, its training summary let go: that holds the session, which cannot be
    sent to tasks with the model once anything was observed (``DataFrame.observe``) in it."""
    model._java_obj.setSummary(SparkSession.active()._jvm.scala.Option.empty())
    return model


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt out (by ``keys``, if any) so that costly work on its rows uses
    all cores: a Parquet file of one row group is read by one task, whatever its size."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *keys)


def drop_staged(*tables: DataFrame) -> None:
    """Removes tables of :func:`stage_table` after their last reader."""
    for t in tables:
        for folder in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            drop_path(t.sparkSession, folder)


def release_shuffles(spark: SparkSession) -> None:
    """Asks the driver's JVM for a garbage collection: Spark removes the
    shuffle files of plans that nothing refers to any more only then, by
    itself every half hour. For steps that shuffle much and are written out."""
    spark.sparkContext._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss)."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
