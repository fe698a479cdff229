"""Table sources and sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

FORMATS = ("csv", "parquet", "json")

#: Both ways: quotes inside quoted values are doubled, and NULL has a mark of its own so that
#: it differs from an empty text.
CSV_OPTIONS = {
    "header": "true",
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
}
#: Times keep their microseconds, and white space at either end of a value is part of it.
CSV_WRITING = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def _check(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"format must be one of {', '.join(FORMATS)}, not {fmt}")


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    multi_line: bool = True,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """Open a table. Without ``schema``, CSV types are inferred by an extra scan.

    Declare a schema for large CSV or JSON inputs: inference reads all of them. With
    ``multi_line`` a quoted CSV value may hold line breaks, and a file is read by one
    task; ``multi_line=False`` splits large files that have none. CSV rows that do not
    fit raise. ``options`` of the reader take precedence: other files may write NULL as
    an empty field (``{"nullValue": ""}``).
    """
    _check(fmt)
    reader = spark.read
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.options(**CSV_OPTIONS, multiLine=multi_line, mode="FAILFAST", inferSchema=schema is None)
    return reader.options(**(options or {})).format(fmt).load(path)


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: Sequence[str] = (),
    options: Mapping[str, str] | None = None,
) -> None:
    """Write a table in parallel, one file per task; :func:`read_table` gives back the same rows."""
    _check(fmt)
    writer = df.write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.options(**CSV_OPTIONS, **CSV_WRITING)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.options(**(options or {})).save(path)
