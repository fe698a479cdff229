"""Value counts, category frequencies, histograms and density curves."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.cluster import local_table
from tablecraft.functions.columns import (
    categorical_columns,
    finite_sql,
    literal,
    numeric_columns,
    present,
    present_sql,
    require_columns,
)
from tablecraft.functions.reshape import as_text, melt

#: Beyond this many bandwidths the kernel is 0 in double precision, so that nothing is left out.
KERNEL_REACH = 38.7
#: Width of a cell of the density estimate in bandwidths, and the moments kept of its values.
CELL = 0.1
MOMENTS = 5


def value_counts(
    df: DataFrame, cols: Sequence[str], dropna: bool = False, order: str | None = "value"
) -> DataFrame:
    """``column, value, count`` for several columns in one pass.

    ``order`` is ``"value"`` (native order, missing first), ``"count"`` (most
    frequent first, ties by value) or None for no sort at all.
    """
    names = require_columns(df, cols)[0]
    long, slots = melt(df, names, dropna)
    typed = list(dict.fromkeys(slots.values()))
    counted = long.groupBy("column", *typed).agg(F.count(F.lit(1)).alias("count"))
    if order == "value":
        counted = counted.orderBy("column", *typed)
    elif order == "count":
        counted = counted.orderBy("column", F.desc("count"), *typed)
    elif order is not None:
        raise ValueError("order must be 'value', 'count' or None")
    return counted.select("column", as_text(typed).alias("value"), "count")


def frequencies(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``column, value, count, share``: the numbers behind a count plot.

    Missing values are left out, also from the total. Totals come from a second
    small aggregate (one row per column, so its broadcast is bounded by the
    schema), not from a window that would gather a column in one task.
    """
    names = categorical_columns(df) if cols is None else require_columns(df, cols)[0]
    if not names:
        schema = "column string, value string, count long, share double"
        return local_table(df.sparkSession, [], schema)
    counted = value_counts(df, names, dropna=True, order=None)
    totals = counted.groupBy("column").agg(F.sum("count").alias("total"))
    return counted.join(F.broadcast(totals), "column").select(
        "column", "value", "count", (F.col("count") / F.col("total")).alias("share")
    )


def _spans(df: DataFrame, names: Sequence[str]) -> list[dict]:
    """Fitted minimum, maximum, deviation and count of each column's finite values (one job)."""
    aggregates = []
    for i, x in enumerate(finite_sql(df, names).values()):
        aggregates += [
            f"min({x}) AS lo{i}", f"max({x}) AS hi{i}", f"stddev_samp({x}) AS sd{i}", f"count({x}) AS n{i}"
        ]
    row = df.selectExpr(*aggregates).first()
    spans = []
    for i, name in enumerate(names):
        lo, hi, sd, n = (row[f"{stat}{i}"] for stat in ("lo", "hi", "sd", "n"))
        if n:
            spans.append({"column": name, "lo": lo, "hi": hi, "sd": sd, "n": n})
    return spans


def _spans_of(df: DataFrame, names: Sequence[str], spans: Sequence[dict] | None) -> list[dict]:
    """Spans of these columns: those given, or fitted here."""
    if spans is None:
        return _spans(df, names) if names else []
    known = {span["column"]: span for span in spans}
    return [known[name] for name in names if name in known]


def _numeric(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    if cols is None:
        return numeric_columns(df)
    return require_columns(df, cols, kinds=["numeric"])[0]


def histogram(
    df: DataFrame, cols: Sequence[str] | None = None, bins: int = 30, spans: Sequence[dict] | None = None
) -> DataFrame:
    """``column, bin, lower, upper, count`` over equal-width bins, empty ones too.

    The last bin is closed on both sides. A constant column gets bins over half
    a unit to either side. Bins span the finite values; infinite ones, if a column has
    any, are counted in bins -1 and ``bins``, whose edges are both infinite. Two scans:
    one for the ranges, one for the counts; ``spans`` of ``profile.overview`` save the first.
    """
    schema = "column string, lower_bound double, width double"
    names = _numeric(df, cols)
    edges = []
    for span in _spans_of(df, names, spans):
        lo, hi = span["lo"], span["hi"]
        if lo == hi:
            lo, hi = lo - 0.5, hi + 0.5
        edges.append((span["column"], lo, (hi - lo) / bins))
    frame = (
        local_table(df.sparkSession, edges, schema)
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .select(
            "column",
            "bin",
            (F.col("lower_bound") + F.col("bin") * F.col("width")).alias("lower"),
            (F.col("lower_bound") + (F.col("bin") + 1) * F.col("width")).alias("upper"),
        )
    )
    if not edges:
        return frame.withColumn("count", F.lit(0).cast("long"))
    # least() skips NULLs, so missing values have to be kept out of it.
    values = finite_sql(df, [name for name, _, _ in edges])
    beyond = {name: f"CAST({text} AS DOUBLE)" for name, text in present_sql(df, values).items()}
    placed = df.selectExpr(
        *[
            f"CAST(CASE WHEN {values[name]} IS NOT NULL THEN "
            f"least(floor(({values[name]} - {literal(lo)}) / {literal(width)}), {bins - 1}) "
            f"WHEN {beyond[name]} > 0 THEN {bins} WHEN {beyond[name]} < 0 THEN -1 END AS INT) AS b{i}"
            for i, (name, lo, width) in enumerate(edges)
        ]
    )
    label = F.create_map(
        *[x for i, (name, _, _) in enumerate(edges) for x in (F.lit(f"b{i}"), F.lit(name))]
    )
    counted = (
        placed.unpivot([], placed.columns, "__b", "bin")
        .where(F.col("bin").isNotNull())
        .groupBy("__b", "bin")
        .agg(F.count(F.lit(1)).alias("count"))
        .select(label[F.col("__b")].alias("column"), "bin", "count")
    )
    # Both sides hold at most (number of columns x (bins + 2)) rows.
    inside = frame.join(F.broadcast(counted), ["column", "bin"], "left").fillna(0, ["count"])
    edge = F.when(F.col("bin") < 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    outside = counted.where(~F.col("bin").between(0, bins - 1)).select(
        "column", "bin", edge.alias("lower"), edge.alias("upper"), "count"
    )
    return inside.unionAll(outside)


def kde(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    grid: int = 200,
    exact: bool = False,
    spans: Sequence[dict] | None = None,
) -> DataFrame:
    """``column, x, density``: Gaussian density on ``grid`` points over the range.

    Scott's bandwidth. Values are gathered in cells of CELL bandwidths with their moments up
    to the MOMENTS-th, from which the kernels of all values of a cell are summed at once; what
    this leaves out is below 1e-9 of the kernel's height. Only one row per task and used
    cell is shuffled. With ``exact`` every value adds its own kernel to the grid points within
    reach. Columns with fewer than two distinct values have no density and give no rows;
    infinite values have no place on the grid and are left out of the estimate.
    """
    names = _numeric(df, cols)
    fits = []
    for span in _spans_of(df, names, spans):
        if span["sd"] and span["hi"] > span["lo"]:
            width = span["sd"] * span["n"] ** -0.2
            step = (span["hi"] - span["lo"]) / (grid - 1)
            fits.append((span["column"], span["lo"], step, width, span["n"]))
    frame = (
        local_table(
            df.sparkSession,
            [(c, lo, step) for c, lo, step, _, _ in fits],
            "column string, lo double, step double",
        )
        .withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        .select("column", "point", (F.col("lo") + F.col("point") * F.col("step")).alias("x"))
    )
    if not fits:
        return frame.select("column", "x", F.lit(0.0).alias("density"))
    values = finite_sql(df, [name for name, *_ in fits])
    packed = []
    for i, (name, lo, step, width, n) in enumerate(fits):
        packed.append(
            F.struct(
                F.lit(name).alias("column"),
                F.expr(values[name]).alias("value"),
                F.lit(lo).alias("lo"),
                F.lit(step).alias("step"),
                F.lit(width).alias("width"),
                F.lit(n * width * math.sqrt(2 * math.pi)).alias("norm"),
            ).alias(f"p{i}")
        )
    long = df.select(*packed)
    long = long.unpivot([], long.columns, "__p", "p").select("p.*").where("value is not null")
    if not exact:
        return _placed_on(frame, _cell_sums(long, grid))
    middle = (F.col("value") - F.col("lo")) / F.col("step")
    reach = F.lit(KERNEL_REACH) * F.col("width") / F.col("step")
    first = F.greatest(F.ceil(middle - reach), F.lit(0)).cast("int")
    last = F.least(F.floor(middle + reach), F.lit(grid - 1)).cast("int")
    offset = (F.col("lo") + F.col("point") * F.col("step") - F.col("value")) / F.col("width")
    sums = (
        long.where(first <= last)
        .withColumn("point", F.explode(F.sequence(first, last)))
        .groupBy("column", "point")
        .agg(F.sum(F.exp(-0.5 * offset * offset) / F.col("norm")).alias("density"))
    )
    return _placed_on(frame, sums)


def _placed_on(frame: DataFrame, sums: DataFrame) -> DataFrame:
    # Both sides hold at most (number of columns x grid) rows.
    return (
        frame.join(F.broadcast(sums), ["column", "point"], "left")
        .fillna(0.0, ["density"])
        .select("column", "x", "density")
    )


def _cell_sums(long: DataFrame, grid: int) -> DataFrame:
    """``column, point, density`` from moments of cells.

    With u the distance of a grid point from the middle of a cell and d that of a value,
    both in bandwidths, exp(-(u - d)^2 / 2) is exp(-u^2 / 2) times the sum over k of
    d^k / k! He_k(u), He_k being the Hermite polynomials.
    """
    size = F.lit(CELL) * F.col("width")
    cell = F.floor((F.col("value") - F.col("lo")) / size)
    placed = long.withColumn("cell", cell).withColumn(
        "d", (F.col("value") - F.col("lo") - (F.col("cell") + 0.5) * size) / F.col("width")
    )
    power = [F.lit(1.0)]
    for _ in range(MOMENTS):
        power.append(power[-1] * F.col("d"))
    fitted = ["column", "lo", "step", "width", "norm"]
    cells = placed.groupBy(*fitted, "cell").agg(*[F.sum(p).alias(f"m{k}") for k, p in enumerate(power)])
    middle = F.col("lo") + (F.col("cell") + 0.5) * size
    reach = F.lit(KERNEL_REACH + CELL) * F.col("width")
    first = F.greatest(F.ceil((middle - reach - F.col("lo")) / F.col("step")), F.lit(0)).cast("int")
    last = F.least(F.floor((middle + reach - F.col("lo")) / F.col("step")), F.lit(grid - 1)).cast("int")
    spread = cells.where(first <= last).withColumn("point", F.explode(F.sequence(first, last)))
    u = (F.col("lo") + F.col("point") * F.col("step") - middle) / F.col("width")
    spread = spread.withColumn("u", u)
    # He_0 = 1, He_1 = u, He_k+1 = u He_k - k He_k-1.
    hermite = [F.lit(1.0), F.col("u")]
    for k in range(1, MOMENTS):
        hermite.append(F.col("u") * hermite[k] - F.lit(float(k)) * hermite[k - 1])
    terms = sum((F.col(f"m{k}") * hermite[k] / F.lit(float(math.factorial(k))) for k in range(1, MOMENTS + 1)), F.col("m0"))
    return spread.groupBy("column", "point").agg(
        F.sum(F.exp(-0.5 * F.col("u") * F.col("u")) * terms / F.col("norm")).alias("density")
    )
