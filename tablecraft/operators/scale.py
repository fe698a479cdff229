"""Z-score and min-max scaling: fitted once, applied to any table with the same columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import present, present_sql, require_columns
from tablecraft.functions.reshape import COLUMNS_PER_PASS

# Names of the vector columns that scaling adds.
STANDARD_OUTPUT = "scaled_features_standard"
MINMAX_OUTPUT = "scaled_features_minmax"
ON_MISSING = ("error", "skip", "keep")


@dataclass(frozen=True)
class Scaler:
    """``(x - origin) * factor + start`` per column; a factor of 0 stands for a constant column."""

    lines: Mapping[str, tuple[float, float, float]]
    suffix: str
    output: str

    def _scaled(self, df: DataFrame, name: str) -> Column:
        origin, factor, start = self.lines[name]
        x = present(df, name).cast("double")
        if not factor:
            return F.when(x.isNotNull(), F.lit(start))
        return (x - F.lit(origin)) * F.lit(factor) + F.lit(start)

    def columns(self, df: DataFrame) -> DataFrame:
        """Add ``<column>_<suffix>``; missing values stay NULL."""
        require_columns(df, self.lines, kinds=["numeric"])
        return df.withColumns({f"{c}_{self.suffix}": self._scaled(df, c) for c in self.lines})

    def vector(self, df: DataFrame, on_missing: str = "error") -> DataFrame:
        """Add one vector of all columns. Missing values raise, drop the row, or stay NaN (``keep``)."""
        if on_missing not in ON_MISSING:
            raise ValueError(f"on_missing must be one of {', '.join(ON_MISSING)}")
        require_columns(df, self.lines, kinds=["numeric"])
        parts = [self._scaled(df, c) for c in self.lines]
        if on_missing == "skip":
            df = df.where(" AND ".join(f"({x}) IS NOT NULL" for x in present_sql(df, self.lines).values()))
        elif on_missing == "keep":
            parts = [F.coalesce(p, F.lit(float("nan"))) for p in parts]
        else:
            parts = [
                F.coalesce(p, F.raise_error(F.lit(f"{c} has missing values")).cast("double"))
                for p, c in zip(parts, self.lines)
            ]
        return df.withColumn(self.output, array_to_vector(F.array(*parts)))


def _fitted(df: DataFrame, cols: Sequence[str], first: str, second: str) -> list[tuple[str, float | None, float | None]]:
    """Two aggregates per column, in one row of aggregates per block of columns."""
    found = []
    for at in range(0, len(cols), COLUMNS_PER_PASS):
        block = cols[at : at + COLUMNS_PER_PASS]
        texts = present_sql(df, block).values()
        row = df.selectExpr(*[f"CAST({fn}({x}) AS DOUBLE)" for x in texts for fn in (first, second)]).first()
        found += [(name, row[2 * i], row[2 * i + 1]) for i, name in enumerate(block)]
    return found


def fit_standard(df: DataFrame, cols: Sequence[str], strict: bool = True) -> Scaler:
    """Mean 0 and sample deviation 1 on ``df``; constants become 0."""
    valid, _ = require_columns(df, cols, strict, ["numeric"])
    lines = {
        name: (mean or 0.0, 1 / deviation if deviation else 0.0, 0.0)
        for name, mean, deviation in _fitted(df, valid, "avg", "stddev_samp")
    }
    return Scaler(lines, "standard", STANDARD_OUTPUT)


def fit_minmax(
    df: DataFrame, cols: Sequence[str], lo: float = 0.0, hi: float = 1.0, strict: bool = True
) -> Scaler:
    """The range on ``df`` becomes [lo, hi]; constants go to the middle."""
    valid, _ = require_columns(df, cols, strict, ["numeric"])
    lines = {}
    for name, low, high in _fitted(df, valid, "min", "max"):
        if low is None or low == high:
            lines[name] = (0.0, 0.0, (lo + hi) / 2)
        else:
            lines[name] = (low, (hi - lo) / (high - low), lo)
    return Scaler(lines, "minmax", MINMAX_OUTPUT)


def _applied(scaler: Scaler, df: DataFrame, as_columns: bool, on_missing: str) -> DataFrame:
    if not scaler.lines:
        return df
    return scaler.columns(df) if as_columns else scaler.vector(df, on_missing)


def standard(
    df: DataFrame,
    cols: Sequence[str],
    as_columns: bool = False,
    on_missing: str = "error",
    strict: bool = True,
) -> DataFrame:
    """:func:`fit_standard` applied to the table it was fitted on, as a vector or as columns."""
    return _applied(fit_standard(df, cols, strict), df, as_columns, on_missing)


def minmax(
    df: DataFrame,
    cols: Sequence[str],
    lo: float = 0.0,
    hi: float = 1.0,
    as_columns: bool = False,
    on_missing: str = "error",
    strict: bool = True,
) -> DataFrame:
    """:func:`fit_minmax` applied to the table it was fitted on, as a vector or as columns."""
    return _applied(fit_minmax(df, cols, lo, hi, strict), df, as_columns, on_missing)
