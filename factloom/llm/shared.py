"""Pieces that several training-data operators use: columns, tables, staging.

Nothing here touches a machine-local folder on a cluster: intermediate tables
go to the folder that ``spark.checkpoint.dir`` names, which every executor
shares, so a lost executor costs a reread and not the data.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts, [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"
WHITE_RUN = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str = "text") -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else; lower() does just that for ASCII texts and is faster."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def word_array(c: Column) -> Column:
    r"""All [^\x20\x09-\x0D]+ of a text, in order."""
    return F.array_remove(F.split(c, WHITE_RUN), "")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share. Where none is configured, a local master gets one of its own (tests); a cluster has none to give."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return found
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="factloom-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, one for each name given."""
    tag = uuid.uuid4().hex[:12]
    return [f"_{n}_{tag}" for n in names]


def staged(df: DataFrame, label: str, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Writes df as a table in the shared folder; the table read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/factloom/{label}-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Removes staged tables that no later plan reads."""
    for p in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(p)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
