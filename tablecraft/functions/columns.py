"""Schema checks (no Spark job) and null/NaN aware column expressions."""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def quoted(name: str) -> str:
    """A column name as SQL text, also when it holds dots or backticks."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: str | float) -> str:
    """A string or double as SQL text."""
    if isinstance(value, float):
        return f"{value!r}D" if math.isfinite(value) else f"CAST('{value}' AS DOUBLE)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ref(name: str) -> Column:
    """Column by its exact name."""
    return F.col(quoted(name))


def kind(dtype: T.DataType) -> str:
    """Coarse role of a type: numeric, categorical, boolean, temporal or other."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.StringType):
        return "categorical"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "temporal"
    return "other"


def numeric_columns(df: DataFrame) -> list[str]:
    """Names of all numeric columns, decimals and short integers included."""
    return [f.name for f in df.schema.fields if kind(f.dataType) == "numeric"]


def categorical_columns(df: DataFrame) -> list[str]:
    """Names of all string columns."""
    return [f.name for f in df.schema.fields if kind(f.dataType) == "categorical"]


def require_columns(
    df: DataFrame,
    cols: Iterable[str],
    strict: bool = True,
    kinds: Sequence[str] | None = None,
) -> tuple[list[str], list[str]]:
    """Split ``cols`` into usable and ignored ones by looking at the schema alone.

    A column is usable when it exists and, if ``kinds`` is given, has one of
    these kinds. ``strict`` raises instead of ignoring.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    valid: list[str] = []
    ignored: list[str] = []
    for name in dict.fromkeys(cols):
        usable = name in types and (kinds is None or kind(types[name]) in kinds)
        (valid if usable else ignored).append(name)
    if strict and ignored:
        wanted = f" of kind {'/'.join(kinds)}" if kinds else ""
        raise ValueError(f"no such column{wanted}: {', '.join(ignored)}")
    return valid, ignored


def dtype_of(df: DataFrame, name: str) -> T.DataType:
    return next(f.dataType for f in df.schema.fields if f.name == name)


def is_fractional(dtype: T.DataType) -> bool:
    """Whether values of this type can be NaN."""
    return isinstance(dtype, (T.DoubleType, T.FloatType))


def present_sql(df: DataFrame, names: Iterable[str]) -> dict[str, str]:
    """Per column, SQL text of its value with NaN turned into NULL.

    Expressions over many columns are written as SQL text: a wide table would
    otherwise need a call into the JVM for every part of every expression.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    found = {}
    for name in names:
        text = quoted(name)
        if is_fractional(types[name]):
            text = f"nanvl({text}, CAST(NULL AS {types[name].simpleString()}))"
        found[name] = text
    return found


def finite_sql(df: DataFrame, names: Sequence[str]) -> dict[str, str]:
    """Per column, SQL text of its value as a double, NULL where it is missing or infinite."""
    found = {}
    for name, text in present_sql(df, names).items():
        value = f"CAST({text} AS DOUBLE)"
        found[name] = f"CASE WHEN abs({value}) < CAST('Infinity' AS DOUBLE) THEN {value} END"
    return found


def present(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL, so that one null test finds both."""
    return F.expr(present_sql(df, [name])[name])


def ratio(part: Column, whole: Column, empty: float | None = None) -> Column:
    """``part / whole``; ``empty`` (NULL by default) where ``whole`` is zero."""
    quotient = part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))
    return quotient if empty is None else F.coalesce(quotient, F.lit(empty))
