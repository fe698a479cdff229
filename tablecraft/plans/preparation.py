"""A chain of preparation steps with one combined report."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.cluster import fresh_path, local_table
from tablecraft.operators import duplicates, encode, missing, scale
from tablecraft.operators.missing import REPORT_SCHEMA, Prepared
from tablecraft.sources.tables import read_table, write_table


def _note(df: DataFrame, step: str, cols: Sequence[str] | None, status: str) -> DataFrame:
    rows = [(step, c, status, None) for c in (cols or df.columns)]
    return local_table(df.sparkSession, rows, REPORT_SCHEMA)


def _tell(step: str, counts: DataFrame) -> DataFrame:
    """Row counts of a step as report rows; the counting runs when the report is read."""
    long = counts.unpivot([], counts.columns, "what", "n")
    return long.select(
        F.lit(step).alias("step"),
        F.lit(None).cast("string").alias("column"),
        F.col("what").alias("status"),
        F.col("n").cast("string").alias("value"),
    )


def _drop_rows(df: DataFrame, cols: Sequence[str] | None = None) -> Prepared:
    counts = missing.drop_rows_report(df, cols)
    return Prepared(missing.drop_rows(df, cols), _tell("drop_rows", counts))


def _drop_duplicates(df: DataFrame, cols: Sequence[str] | None = None, **options: Any) -> Prepared:
    table, counts = duplicates.drop_with_report(df, cols, **options)
    return Prepared(table, _tell("drop_duplicates", counts))


def _noted(name: str, operator, status: str):
    def step(df: DataFrame, cols: Sequence[str], **options: Any) -> Prepared:
        return Prepared(operator(df, cols, **options), _note(df, name, cols, status))

    return step


STEPS = {
    "fill_mean": missing.fill_mean,
    "fill_median": missing.fill_median,
    "fill_mode": missing.fill_mode,
    "fill_values": missing.fill_values,
    "drop_rows": _drop_rows,
    "drop_duplicates": _drop_duplicates,
    "label_encode": _noted("label_encode", encode.label_encode, "encoded"),
    "onehot": _noted("onehot", encode.onehot, "encoded"),
    "onehot_vector": _noted("onehot_vector", encode.onehot_vector, "encoded"),
    "standard_scale": _noted("standard_scale", scale.standard, "scaled"),
    "minmax_scale": _noted("minmax_scale", scale.minmax, "scaled"),
}


def _written(df: DataFrame, name: str) -> DataFrame:
    path = fresh_path(df.sparkSession, name)
    write_table(df, path, "parquet")
    return read_table(df.sparkSession, path, "parquet", df.schema)


def run(
    df: DataFrame,
    steps: Sequence[tuple[str, Mapping[str, Any]]],
    write_after: Sequence[str] = (),
) -> Prepared:
    """Apply ``(step name, options)`` in order; the report adds the step's number.

    Fills, encoders and scalers fit on the table as it stands at their turn, so
    each of them runs the steps before it again. Steps named in ``write_after``
    have their table written to the shared folder when others follow: worth it
    after a step that shuffles, such as ``drop_duplicates``, since the next ones
    then read only the columns they fit on.
    """
    unknown = {name for name, _ in steps} | set(write_after)
    if unknown - set(STEPS):
        raise ValueError(f"step must be one of {', '.join(STEPS)}, not {sorted(unknown - set(STEPS))}")
    reports = []
    for number, (name, options) in enumerate(steps, 1):
        df, told = STEPS[name](df, **options)
        reports.append(told.select(F.lit(number).alias("number"), *told.columns))
        if name in write_after and number < len(steps):
            df = _written(df, name)
    if not reports:
        return Prepared(df, local_table(df.sparkSession, [], f"number int, {REPORT_SCHEMA}"))
    return Prepared(df, reduce(DataFrame.unionAll, reports))
