"""Reports on missing values, and filling or dropping them.

Counting tells NULL and NaN apart; filling and dropping treat both as missing.
Fill values are fitted in one job over all columns and then applied as
constants, so the filled table itself stays lazy.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from decimal import Decimal, localcontext
from functools import reduce
from operator import or_
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.cluster import local_table
from tablecraft.functions.columns import (
    dtype_of,
    is_fractional,
    literal,
    present,
    present_sql,
    quoted,
    require_columns,
)
from tablecraft.functions.ordered import quantiles
from tablecraft.functions.reshape import melt, per_column


class Prepared(NamedTuple):
    """A changed table and a small report about the change."""

    table: DataFrame
    report: DataFrame


#: Units of the last place below which a double gives back the long or decimal it was made from.
EXACT_UNITS = 10**15

REPORT_SCHEMA = "step string, column string, status string, value string"


def counts(df: DataFrame) -> DataFrame:
    """Number of NULLs per column."""
    stats = {c: {"null_count": f"count_if({quoted(c)} IS NULL)"} for c in df.columns}
    return per_column(df, stats, "column string, null_count long")


def _percent(name: str) -> str:
    nulls = f"count_if({quoted(name)} IS NULL)"
    return f"coalesce(try_divide(CAST({nulls} AS DOUBLE), count(1)), 0.0D) * 100.0D"


def percentages(df: DataFrame) -> DataFrame:
    """Percentage of NULLs per column; 0.0 for an empty table."""
    stats = {c: {"null_pct": _percent(c)} for c in df.columns}
    return per_column(df, stats, "column string, null_pct double")


def report(df: DataFrame) -> DataFrame:
    """Per column: rows, NULLs, NaNs, NULL percentage (2 decimals) and a flag."""
    stats = {}
    for field in df.schema.fields:
        column = quoted(field.name)
        nan = f"isnan({column})" if is_fractional(field.dataType) else "false"
        stats[field.name] = {
            "total_rows": "count(1)",
            "null_count": f"count_if({column} IS NULL)",
            "nan_count": f"count_if({nan})",
            "null_pct": f"round({_percent(field.name)}, 2)",
            "has_missing": f"count_if({column} IS NULL) > 0",
        }
    return per_column(
        df,
        stats,
        "column string, total_rows long, null_count long, nan_count long, "
        "null_pct double, has_missing boolean",
    )


def _constant(value: Any, dtype: T.DataType) -> Column:
    return F.lit(value).cast(dtype)


def _apply(df: DataFrame, values: Mapping[str, Any], widen: bool = False) -> DataFrame:
    filled = {}
    for name, value in values.items():
        dtype = dtype_of(df, name)
        column = present(df, name)
        if widen and isinstance(dtype, T.IntegralType):
            dtype = T.DoubleType()
            column = column.cast(dtype)
        filled[name] = F.coalesce(column, _constant(value, dtype))
    return df.withColumns(filled) if filled else df


def _report(
    df: DataFrame, step: str, values: Mapping[str, Any], empty: Sequence[str], ignored: Sequence[str]
) -> DataFrame:
    rows = [(step, c, "filled", str(v)) for c, v in values.items()]
    rows += [(step, c, "no_data", None) for c in empty]
    rows += [(step, c, "ignored", None) for c in ignored]
    return local_table(df.sparkSession, rows, REPORT_SCHEMA)


def _finish(
    df: DataFrame,
    step: str,
    fitted: Mapping[str, Any],
    ignored: Sequence[str],
    widen: bool = False,
    digits: int | None = None,
) -> Prepared:
    values = {c: v for c, v in fitted.items() if v is not None}
    empty = [c for c, v in fitted.items() if v is None]
    with localcontext() as exact:
        exact.prec = 60
        shown = {c: round(v, digits) if digits is not None else v for c, v in values.items()}
    return Prepared(_apply(df, values, widen), _report(df, step, shown, empty, ignored))


def fill_mean(
    df: DataFrame, cols: Sequence[str], widen: bool = False, strict: bool = True
) -> Prepared:
    """Fill numeric columns with their mean.

    Integer columns keep their type, so the mean is truncated towards zero;
    ``widen`` turns them into doubles instead. A column without any value is
    left alone and reported as ``no_data``.
    """
    valid, ignored = require_columns(df, cols, strict, ["numeric"])
    fitted: dict[str, Any] = {}
    if valid:
        means = [f"CAST(avg({x}) AS DOUBLE)" for x in present_sql(df, valid).values()]
        fitted = dict(zip(valid, df.selectExpr(*means).first()))
    return _finish(df, "fill_mean", fitted, ignored, widen, digits=4)


def _exact_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, Any]:
    """Exact medians, all columns of a type together.

    Types that a double holds without loss share one pass; long and decimal
    values are ranked and returned in their own type.
    """
    medians: dict[str, Any] = dict.fromkeys(cols)
    by_type: dict[str, list[str]] = {}
    columns = {}
    for name in cols:
        dtype = dtype_of(df, name)
        own = isinstance(dtype, (T.LongType, T.DecimalType))
        group = dtype.simpleString() if own else "double"
        by_type.setdefault(group, []).append(name)
        columns[name] = present(df, name).cast(group)
    for group in by_type.values():
        long, slots = melt(df.select(*[columns[c].alias(c) for c in group]), group)
        rows = quantiles(
            long, slots[group[0]], [0.5], ["median"], keys=["column"], discrete=True
        ).collect()
        medians.update({row["column"]: row["median"] for row in rows})
    for name, value in medians.items():
        if value is not None and isinstance(dtype_of(df, name), T.IntegralType):
            medians[name] = int(value)
    return medians


def _own(value: float, dtype: T.DataType) -> Any:
    """A double as the long or decimal it was made from."""
    if isinstance(dtype, T.DecimalType):
        with localcontext() as exact:
            exact.prec = 60
            return Decimal(repr(value)).quantize(Decimal(1).scaleb(-dtype.scale))
    return int(value)


def _exact(value: float, dtype: T.DataType) -> bool:
    """Whether no other long or decimal of this type has the same double."""
    scale = dtype.scale if isinstance(dtype, T.DecimalType) else 0
    return abs(value) * 10**scale < EXACT_UNITS


def _own_literal(value: Any, dtype: T.DataType) -> str:
    return f"CAST('{value:f}' AS {dtype.simpleString()})" if isinstance(dtype, T.DecimalType) else f"{value}L"


def _sketched_medians(df: DataFrame, cols: Sequence[str], relative_error: float) -> dict[str, Any]:
    """Medians with a rank off by ``relative_error`` at most, all columns together.

    A sketch works on doubles, and large longs and decimals share one. So a double is
    taken as their leading digits: where many rows share those of the median, the
    remainders of these rows are sketched in turn, which are small enough to be exact.
    One job for most tables, three for long columns, five at the most.
    """
    texts = present_sql(df, cols)
    types = {c: dtype_of(df, c) for c in cols}
    wide = [c for c in cols if isinstance(types[c], (T.LongType, T.DecimalType))]
    fine = math.ceil(4 / relative_error)
    row = df.selectExpr(
        *[
            f"percentile_approx(CAST({x} AS DOUBLE), 0.5, {fine})" if c in wide
            else f"percentile_approx({x}, 0.5, {math.ceil(1 / relative_error)})"
            for c, x in texts.items()
        ],
        *[f"count({texts[c]})" for c in wide],
    ).first()
    found = dict(zip(cols, row))
    total = dict(zip(wide, row[len(cols) :]))
    digits = {c: f"CAST({texts[c]} AS DOUBLE)" for c in wide}
    within = {c: f"{texts[c]} IS NOT NULL" for c in wide}
    base: dict[str, Any] = {}
    below = dict.fromkeys(wide, 0)
    sizes: dict[str, int] = {}
    while wide:
        leading = {c: found[c] for c in wide}
        for c, digit in leading.items():
            # Subtracting decimals of 38 digits may round the last one away.
            rounded = c in base and getattr(types[c], "precision", 0) == 38
            if digit is not None and _exact(digit, types[c]) and not rounded:
                found[c] = base.get(c, 0) + _own(digit, types[c])
        wide = [c for c in wide if found[c] is leading[c] and found[c] is not None]
        if not wide:
            break
        parts = []
        for c in wide:
            here = f"{within[c]} AND {digits[c]} = {literal(leading[c])}"
            parts += [
                f"count_if({within[c]} AND {digits[c]} < {literal(leading[c])})", f"count_if({here})",
                f"min(CASE WHEN {here} THEN {texts[c]} END)", f"max(CASE WHEN {here} THEN {texts[c]} END)",
            ]
            within[c] = here
        row = df.selectExpr(*parts).first()
        asked = []
        for c, (less, same, least, most) in zip(list(wide), zip(*[iter(row)] * 4)):
            below[c] += less
            if least == most or 2 * same <= relative_error * total[c] or same == sizes.get(c):
                found[c] = least
                wide.remove(c)
                continue
            base[c], sizes[c] = least, same
            digits[c] = f"CAST({texts[c]} - {_own_literal(least, types[c])} AS DOUBLE)"
            share = min(max((total[c] + 1) // 2 - below[c], 1), same) / same
            asked.append(f"percentile_approx(CASE WHEN {within[c]} THEN {digits[c]} END, {share!r}D, {fine})")
        if asked:
            found.update(zip(wide, df.selectExpr(*asked).first()))
    return found


def fill_median(
    df: DataFrame,
    cols: Sequence[str],
    relative_error: float = 0.01,
    widen: bool = False,
    strict: bool = True,
) -> Prepared:
    """Fill numeric columns with their median, which is one of their own values.

    Its rank may be off by ``relative_error``; 0 asks for the exact median.
    The sketch sees all columns together, and the exact form counts values
    in parallel instead of gathering them in one place.
    """
    valid, ignored = require_columns(df, cols, strict, ["numeric"])
    fitted: dict[str, Any] = {}
    if valid and relative_error > 0:
        fitted = _sketched_medians(df, valid, relative_error)
    elif valid:
        fitted = _exact_medians(df, valid)
    return _finish(df, "fill_median", fitted, ignored, widen, digits=4)


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, Any]:
    """Most frequent value per column in its own type; the lowest among ties."""
    if not cols:
        return {}
    long, slots = melt(df, cols)
    counted = long.groupBy("column", *dict.fromkeys(slots.values())).agg(
        F.count(F.lit(1)).alias("n")
    )
    best = [
        f"min(CASE WHEN column = {literal(c)} THEN struct(-n AS n, {slots[c]} AS v) END)" for c in cols
    ]
    row = counted.selectExpr(*best).first()
    return {c: (None if best is None else best["v"]) for c, best in zip(cols, row)}


def fill_mode(df: DataFrame, cols: Sequence[str], strict: bool = True) -> Prepared:
    """Fill columns of any type with their most frequent value."""
    valid, ignored = require_columns(df, cols, strict)
    return _finish(df, "fill_mode", modes(df, valid), ignored)


def fill_values(df: DataFrame, values: Mapping[str, Any], strict: bool = True) -> Prepared:
    """Fill columns with given constants, cast to the column's type."""
    valid, ignored = require_columns(df, values, strict)
    return _finish(df, "fill_values", {c: values[c] for c in valid}, ignored)


def drop_rows(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a missing value in ``cols`` (default: in any column)."""
    names = df.columns if cols is None else require_columns(df, cols)[0]
    return df.na.drop(how="any", subset=list(names))


def drop_rows_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows before, after and dropped by :func:`drop_rows`, in one scan."""
    names = df.columns if cols is None else require_columns(df, cols)[0]
    lost = reduce(or_, [present(df, c).isNull() for c in names], F.lit(False))
    before, dropped = F.count(F.lit(1)), F.count_if(lost)
    return df.agg(
        before.alias("rows_before"),
        (before - dropped).alias("rows_after"),
        dropped.alias("rows_dropped"),
    )
