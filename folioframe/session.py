"""Session helpers shared by every part of the library."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data directory (one file or a folder of files)."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that executors share. On one machine a folder of its own will do; on a cluster the session
    has to name one."""
    context = spark.sparkContext
    set_already = context._jsc.sc().getCheckpointDir()
    if set_already.isDefined():
        return set_already.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        folder = os.path.join(os.environ.get("FOLIOFRAME_CHECKPOINTS") or tempfile.gettempdir(), "folioframe-checkpoints")
    context.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder, so that later steps neither
    recompute it nor depend on an executor that may be lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
