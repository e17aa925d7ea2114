"""Intermediate tables in the folder that ``spark.checkpoint.dir`` names, which all executors share and which outlives a lost one."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factloom-"))
    return sc._jsc.sc().getCheckpointDir().get()


def kept(df: DataFrame) -> DataFrame:
    """The rows, computed once."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def measured(df: DataFrame) -> DataFrame:
    """The rows, computed once, as a table whose size the optimizer knows: it broadcasts a small one and no large one."""
    path = f"{shared_folder(df.sparkSession)}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
