"""Shared-storage helpers: lineage cuts go to the folder the cluster names."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where that is unset (tests) and executors
    share this machine a folder of our own is set."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tidewheel-ckpt-"))
    return sc._jsc.sc().getCheckpointDir().get()


def fresh_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def dropped(spark: SparkSession, folder: str) -> None:
    """Remove a folder of ours from the shared storage, once nothing reads it any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: computed once, survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def partitions(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def modest_batches(spark: SparkSession, rows: int = 1000) -> bool:
    """Whole texts go to Python workers ``rows`` at a time, unless the session names a number:
    Spark's own 10,000 long texts are tens of megabytes in the executor and again in the worker.
    True where that was set here; ``usual_batches`` takes it back."""
    if BATCH in spark.conf.getAll:
        return False
    spark.conf.set(BATCH, str(rows))
    return True


def usual_batches(spark: SparkSession) -> None:
    spark.conf.unset(BATCH)
