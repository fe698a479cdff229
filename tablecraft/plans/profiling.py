"""A full profile of a table in one call."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tablecraft.functions.columns import categorical_columns, numeric_columns, require_columns
from tablecraft.operators import distributions, duplicates, profile, relations


def full(
    df: DataFrame,
    target: str | None = None,
    discrete: Sequence[str] = (),
    continuous: Sequence[str] = (),
    by_target: Sequence[str] = (),
    hue: str | None = None,
    sample_order: Sequence[str] = (),
    bins: int = 30,
) -> dict[str, DataFrame]:
    """Every profile table by name; parts that need an absent column are left out.

    Shape, schema, summaries, missing values and the ranges of histogram and density come from
    one scan, correlations from another, when this is called; quartiles of boxes and hashes
    of duplicates are fitted then, too. The rest is lazy.

    ``by_target`` columns are counted per target value; ``hue`` splits the mean
    target per first such column; ``continuous`` columns are boxed per target.
    Persist ``df`` first when it is expensive to compute: each table is a query
    of its own.
    """
    numbers, texts = numeric_columns(df), categorical_columns(df)
    discrete, _ = require_columns(df, discrete, strict=False)
    continuous, _ = require_columns(df, continuous, strict=False, kinds=["numeric"])
    by_target, _ = require_columns(df, by_target, strict=False)
    seen = profile.overview(df)
    named = ("shape", "schema", "numeric_summary", "missing_counts", "missing_percentages")
    tables = {name: seen.tables[name] for name in named}
    tables["sample"] = profile.sample_rows(df, 5, sample_order)
    tables["duplicates"] = duplicates.count(df)
    if texts:
        tables["categorical_summary"] = seen.tables["categorical_summary"]
        tables["frequencies"] = distributions.frequencies(df)
    if numbers:
        tables["histogram"] = distributions.histogram(df, numbers, bins, seen.spans)
        tables["correlation"] = relations.correlation_matrix(df, numbers)
    if continuous:
        tables["kde"] = distributions.kde(df, continuous, spans=seen.spans)
    if discrete:
        tables["value_counts"] = distributions.value_counts(df, discrete)
        tables["discrete_frequencies"] = distributions.frequencies(df, discrete)
    if target in df.columns:
        for name in by_target:
            tables[f"counts_by_target:{name}"] = relations.counts_by_target(df, name, target)
        if by_target and hue in df.columns and target in numbers:
            tables["mean_by_groups"] = relations.mean_by_groups(df, by_target[0], target, hue)
        for name in continuous:
            tables[f"box_stats:{name}"] = relations.box_stats(df, target, name)
    return tables
