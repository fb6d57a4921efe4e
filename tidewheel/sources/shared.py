"""Lineage cuts in storage that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; only where that is unset and executors share this
    machine (tests) one of our own."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidewheel-ckpt-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def fresh_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: computed once, survives lost executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
