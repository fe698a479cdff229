"""Helpers of the operators here: input tables, shared intermediate tables, column names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; set here only where it is unset in a local session."""
    named = spark.conf.get(CHECKPOINT_SETTING, None)
    if not named:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="llm-shared-")
        spark.conf.set(CHECKPOINT_SETTING, named)
    return named.rstrip("/")


class Workspace:
    """Written tables below the shared folder, which cut the lineage and outlive an executor.

    ``drop`` removes a table that no later step reads. What a lazy result still
    reads stays until the owner of the shared folder clears it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, frame: DataFrame, name: str) -> DataFrame:
        frame.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(name: str, taken: Iterable[str]) -> str:
    """``name``, lengthened until no column of ``taken`` has it (letter case does not tell columns apart)."""
    used = {column.lower() for column in taken}
    while name.lower() in used:
        name += "_"
    return name


def shuffle_tasks(spark: SparkSession, rows: int, rows_per_task: int) -> int:
    """Tasks for ``rows``, at least the session's number of shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // rows_per_task))
