"""Registered queries: each operator on the given tables, with SQL of the same meaning."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tablecraft.functions.cluster import CHECKPOINT_SETTING

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _with_folder(function: Query) -> Query:
    """A local session without a shared folder, as in tests, gets one of this machine."""

    @wraps(function)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        if not spark.conf.get(CHECKPOINT_SETTING, None) and spark.sparkContext.master.startswith("local["):
            spark.conf.set(CHECKPOINT_SETTING, tempfile.mkdtemp(prefix="tablecraft-"))
        return function(spark, sf_dir)

    return run


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; without ``sql`` there is no SQL to compare with."""

    def register(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = _with_folder(function)
        if sql is not None:
            SQL[name] = sql.strip()
        return function

    return register


def load_all() -> None:
    """Import every module that registers queries."""
    from registry import distributing, encoding, evaluating, filling, learning, profiling  # noqa: F401
