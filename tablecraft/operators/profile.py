"""Shape, schema, sample rows and per-column summaries."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.cluster import local_table
from tablecraft.functions.columns import (
    categorical_columns,
    finite_sql,
    kind,
    literal,
    numeric_columns,
    present_sql,
    quoted,
    ref,
    require_columns,
)
from tablecraft.functions.ordered import quantiles
from tablecraft.functions.reshape import COLUMNS_PER_PASS, melt, per_column

class Overview(NamedTuple):
    """Tables by name, and range, deviation and number of the finite values of each numeric column."""

    tables: dict[str, DataFrame]
    spans: list[dict]


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}


def shape(df: DataFrame) -> DataFrame:
    """One row: number of rows and of columns."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns")
    )


def schema_report(df: DataFrame) -> DataFrame:
    """One row per column: type, role, nullability and non-null count."""
    counts = {c: {"non_null_count": f"count({quoted(c)})"} for c in df.columns}
    facts = local_table(
        df.sparkSession,
        [
            (i, f.name, f.dataType.simpleString(), kind(f.dataType), f.nullable)
            for i, f in enumerate(df.schema.fields)
        ],
        "position int, column string, dtype string, kind string, nullable boolean",
    )
    counted = per_column(df, counts, "column string, non_null_count long")
    return facts.join(F.broadcast(counted), "column")


def overview(df: DataFrame, block: int = COLUMNS_PER_PASS) -> Overview:
    """Shape, schema, summaries and missing values of all columns from one aggregate.

    The tables equal those of :func:`shape`, :func:`schema_report`, :func:`numeric_summary`,
    :func:`categorical_summary`, ``missing.counts`` and ``missing.percentages``; a row per task
    is shuffled, and a row per table and column is held. ``spans`` are the ranges and deviations that
    histograms and densities need. Tables wider than ``block`` take one scan per block.
    """
    numbers, texts = set(numeric_columns(df)), set(categorical_columns(df))
    values = present_sql(df, df.columns)
    finite = finite_sql(df, [c for c in df.columns if c in numbers])
    found: dict[str, dict] = {}
    rows = 0
    for start in range(0, max(len(df.columns), 1), block):
        asked = ["count(1) AS n_rows"]
        places = list(enumerate(df.columns[start : start + block]))
        for i, c in places:
            x = values[c]
            stats = {"filled": f"count({quoted(c)})"}
            if c in numbers:
                stats |= {
                    "count": f"count({x})", "mean": f"CAST(avg({x}) AS DOUBLE)", "stddev": f"stddev_samp({x})",
                    "min": f"CAST(min({x}) AS DOUBLE)", "max": f"CAST(max({x}) AS DOUBLE)",
                    "lo": f"min({finite[c]})", "hi": f"max({finite[c]})",
                    "sd": f"stddev_samp({finite[c]})", "n": f"count({finite[c]})",
                }
            elif c in texts:
                stats |= {"count": f"count({x})", "min": f"min({x})", "max": f"max({x})"}
            asked += [f"{text} AS c{i}_{stat}" for stat, text in stats.items()]
            found[c] = stats
        row = df.selectExpr(*asked).first()
        rows = row["n_rows"]
        for i, c in places:
            found[c] = {stat: row[f"c{i}_{stat}"] for stat in found[c]}
    summary = ("count", "mean", "stddev", "min", "max")
    missing = {c: rows - f["filled"] for c, f in found.items()}

    def made(lines: list, schema: str) -> DataFrame:
        return local_table(df.sparkSession, lines, schema)

    tables = {
        "shape": made([(rows, len(df.columns))], "n_rows long, n_columns long"),
        "schema": made(
            [
                (f.name, i, f.dataType.simpleString(), kind(f.dataType), f.nullable, found[f.name]["filled"])
                for i, f in enumerate(df.schema.fields)
            ],
            "column string, position int, dtype string, kind string, nullable boolean, non_null_count long",
        ),
        "numeric_summary": made(
            [(c, *(f[k] for k in summary)) for c, f in found.items() if c in numbers],
            "column string, count long, mean double, stddev double, min double, max double",
        ),
        "categorical_summary": made(
            [(c, f["count"], f["min"], f["max"]) for c, f in found.items() if c in texts],
            "column string, count long, min string, max string",
        ),
        "missing_counts": made(list(missing.items()), "column string, null_count long"),
        "missing_percentages": made(
            [(c, n / rows * 100.0 if rows else 0.0) for c, n in missing.items()], "column string, null_pct double"
        ),
    }
    spans = [{"column": c, **{k: f[k] for k in ("lo", "hi", "sd", "n")}} for c, f in found.items() if c in numbers and f["n"]]
    return Overview(tables, spans)


def sample_rows(df: DataFrame, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` rows; with ``order_by`` they are the same in every run."""
    return (df.orderBy(*map(ref, order_by)) if order_by else df).limit(n)


def numeric_summary(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    quartiles: bool = False,
    exact: bool = True,
    relative_error: float = 0.001,
) -> DataFrame:
    """Count, mean, sample deviation, minimum and maximum of numeric columns.

    NULL and NaN are left out. ``quartiles`` adds linearly interpolated
    quartiles, or with ``exact=False`` sketched ones from the same scan.
    """
    names = numeric_columns(df) if cols is None else require_columns(df, cols, kinds=["numeric"])[0]
    schema = "column string, count long, mean double, stddev double, min double, max double"
    stats = {}
    for name, x in present_sql(df, names).items():
        stats[name] = {
            "count": f"count({x})",
            "mean": f"CAST(avg({x}) AS DOUBLE)",
            "stddev": f"stddev_samp({x})",
            "min": f"CAST(min({x}) AS DOUBLE)",
            "max": f"CAST(max({x}) AS DOUBLE)",
        }
        if quartiles and not exact:
            for label, p in QUARTILES.items():
                accuracy = int(1 / relative_error)
                stats[name][label] = f"percentile_approx(CAST({x} AS DOUBLE), {p}, {accuracy})"
    if quartiles and not exact:
        schema += ", q25 double, q50 double, q75 double"
    summary = per_column(df, stats, schema)
    if not (quartiles and exact):
        return summary
    if not names:
        return summary.withColumns({label: F.lit(None).cast("double") for label in QUARTILES})
    values = present_sql(df, names)
    doubles = df.selectExpr(*[f"CAST({values[n]} AS DOUBLE) AS {quoted(n)}" for n in names])
    long, slots = melt(doubles, names)
    ranks = quantiles(
        long, slots[names[0]], list(QUARTILES.values()), list(QUARTILES), keys=["column"]
    ).drop("n")
    # One row per column on both sides, so the right side is bounded by the schema.
    return summary.join(F.broadcast(ranks), "column", "left")


def categorical_summary(
    df: DataFrame, cols: Sequence[str] | None = None, top: bool = False
) -> DataFrame:
    """Count, lowest and highest value of string columns.

    With ``top``: count, distinct values, the most frequent value (the lowest
    one among ties) and how often it occurs.
    """
    names = categorical_columns(df) if cols is None else require_columns(df, cols)[0]
    if not top:
        stats = {
            name: {
                "count": f"count({x})",
                "min": f"CAST(min({x}) AS STRING)",
                "max": f"CAST(max({x}) AS STRING)",
            }
            for name, x in present_sql(df, names).items()
        }
        return per_column(df, stats, "column string, count long, min string, max string")

    schema = "column string, count long, unique long, top string, freq long"
    if not names:
        return local_table(df.sparkSession, [], schema)
    long, slots = melt(df, names)
    counted = long.groupBy("column", *dict.fromkeys(slots.values())).agg(
        F.count(F.lit(1)).alias("n")
    )
    stats = {}
    for name in names:
        mine = f"column = {literal(name)}"
        best = f"min(CASE WHEN {mine} THEN struct(-n AS n, {slots[name]} AS v) END)"
        stats[name] = {
            "count": f"coalesce(sum(CASE WHEN {mine} THEN n END), 0L)",
            "unique": f"count_if({mine})",
            "top": f"CAST({best}.v AS STRING)",
            "freq": f"-{best}.n",
        }
    return per_column(counted, stats, schema)
