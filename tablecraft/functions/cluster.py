"""Small driver-side tables, and where intermediate tables may be written."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_table(spark: SparkSession, rows: Sequence, schema: str | T.StructType) -> DataFrame:
    """A table of a few driver-side rows, read by one task instead of one per core."""
    return spark.createDataFrame(rows, schema).coalesce(1)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``."""
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if not named:
        raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path below the shared folder that nothing has used before."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The table as written to the shared folder, so that later jobs do not make it anew.

    A session without such a folder gets the table as it is.
    """
    spark = df.sparkSession
    if not spark.conf.get(CHECKPOINT_SETTING, None):
        return df
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def enable_checkpoints(spark: SparkSession) -> None:
    """Let iterative learners cut their lineage; keeps a folder already set.

    A session without the setting goes without checkpoints, as the learners allow.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty() and spark.conf.get(CHECKPOINT_SETTING, None):
        context.setCheckpointDir(shared_folder(spark))
