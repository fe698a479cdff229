"""Comparisons between columns: two-way counts, grouped means, box statistics, correlation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.functions import moments
from tablecraft.functions.cluster import kept, local_table
from tablecraft.functions.columns import (
    numeric_columns,
    present,
    present_sql,
    ref,
    require_columns,
)
from tablecraft.functions.ordered import (
    bucket_facts,
    cut_points,
    hold,
    holds,
    interpolated,
    join_buckets,
    opened,
    quantiles,
    wanted_here,
    with_bucket,
)

CORRELATION_SCHEMA = "x string, y string, n long, corr double"
#: Normal quantile of a two-sided 95 % interval.
Z95 = 1.96
# Shares of rows drawn 0, 1, 2, ... times by a Poisson bootstrap, exp(-1) / k!.
POISSON = [math.exp(-1) / math.factorial(k) for k in range(9)]
#: Whisker length in interquartile ranges.
WHISKER = 1.5
QUARTILES = [0.25, 0.5, 0.75]
#: Relative room for the rounding of quartiles between two values.
ROUNDING = 1e-9


def counts_by_target(df: DataFrame, x: str, target: str, dropna: bool = True) -> DataFrame:
    """``x, target, count, share`` with shares within each ``x``."""
    require_columns(df, [x, target])
    pairs = df.select(present(df, x).alias("x"), present(df, target).alias("target"))
    if dropna:
        pairs = pairs.dropna()
    counted = pairs.groupBy("x", "target").agg(F.count(F.lit(1)).alias("count"))
    totals = counted.groupBy(F.col("x").alias("__x")).agg(F.sum("count").alias("total"))
    return counted.join(totals, F.col("x").eqNullSafe(F.col("__x"))).select(
        "x", "target", "count", (F.col("count") / F.col("total")).alias("share")
    )


def mean_by_groups(
    df: DataFrame, x: str, y: str, hue: str | None = None, dropna: bool = True
) -> DataFrame:
    """``x, hue, count, mean, stddev, ci_low, ci_high`` of ``y`` per group.

    The interval is the mean plus and minus 1.96 standard errors; a group of
    one row has no deviation and no interval.
    """
    require_columns(df, [y], kinds=["numeric", "boolean"])
    keys = {"x": x} if hue is None else {"x": x, "hue": hue}
    require_columns(df, keys.values())
    rows = df.select(
        *[present(df, c).alias(k) for k, c in keys.items()], present(df, y).cast("double").alias("y")
    ).where(F.col("y").isNotNull())
    if dropna:
        rows = rows.dropna(subset=list(keys))
    grouped = rows.groupBy(*keys).agg(
        F.count("y").alias("count"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("stddev")
    )
    margin = F.lit(Z95) * F.col("stddev") / F.sqrt("count")
    return grouped.withColumns(
        {"ci_low": F.col("mean") - margin, "ci_high": F.col("mean") + margin}
    )


def _poisson(uniform: Column) -> Column:
    """How often a row is drawn, from a number of 0 to 1: Poisson with mean 1."""
    draws, share, total = F.lit(len(POISSON)), 0.0, []
    for p in POISSON:
        share += p
        total.append(share)
    for k in reversed(range(len(total))):
        draws = F.when(uniform < total[k], k).otherwise(draws)
    return draws


def bootstrap_mean_by_groups(
    df: DataFrame,
    x: str,
    y: str,
    key: str | Sequence[str],
    hue: str | None = None,
    replicates: int = 200,
    level: float = 0.95,
    seed: int = 42,
    dropna: bool = True,
) -> DataFrame:
    """``x, hue, count, mean, ci_low, ci_high``: means with bootstrap intervals.

    Each replicate draws every row a Poisson number of times, which a hash of its ``key``,
    the replicate and the seed decides: so no row is moved for drawing, and the result is
    the same on every layout. Sums are combined map side; per group and replicate one
    row is shuffled. The interval is that of the replicates' means, between the quantiles that
    leave out (1 - ``level``) / 2 on either side.
    """
    require_columns(df, [y], kinds=["numeric", "boolean"])
    keys = {"x": x} if hue is None else {"x": x, "hue": hue}
    ids = require_columns(df, [key] if isinstance(key, str) else key)[0]
    require_columns(df, keys.values())
    digest = F.md5(F.concat_ws(":", *[ref(c).cast("string") for c in ids], F.lit(str(seed))))

    def digits(start: int) -> Column:
        return F.conv(F.substring(digest, start, 8), 16, 10).cast("long")

    rows = df.select(
        *[present(df, c).alias(k) for k, c in keys.items()],
        present(df, y).cast("double").alias("y"),
        digits(1).alias("a"),
        digits(9).alias("b"),
    ).where(F.col("y").isNotNull())
    if dropna:
        rows = rows.dropna(subset=list(keys))
    whole = rows.groupBy(*keys).agg(F.count("y").alias("count"), F.avg("y").alias("mean"))
    drawn = rows.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    # Two hashes of 32 bits give the numbers of all replicates, any two of them independent.
    uniform = (F.col("a") + F.col("replicate") * F.col("b")) % (1 << 32) / F.lit(float(1 << 32))
    drawn = drawn.withColumn("w", _poisson(uniform)).where("w > 0")
    means = drawn.groupBy(*keys, "replicate").agg((F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("m"))
    rest = (1 - level) / 2
    ends = means.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(
        F.percentile("m", rest).alias("ci_low"), F.percentile("m", 1 - rest).alias("ci_high")
    )
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return whole.join(ends, reduce(and_, same), "left").drop(*[f"__{k}" for k in keys])


def _pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    require_columns(df, [x])
    require_columns(df, [y], kinds=["numeric"])
    return df.select(present(df, x).alias("x"), present(df, y).cast("double").alias("y")).dropna()


def _fences(found: DataFrame) -> tuple[DataFrame, bool]:
    """Quartiles with their fences per ``x``, and whether that table is held and broadcast."""
    reach = F.lit(WHISKER) * (F.col("q3") - F.col("q1"))
    fenced = found.withColumns(
        {"fence_low": F.col("q1") - reach, "fence_high": F.col("q3") + reach}
    )
    held = hold(fenced)
    return (fenced, False) if held is None else (held, True)


def _against_fences(rows: DataFrame, pairs: DataFrame, fenced: DataFrame, held: bool) -> DataFrame:
    """Add the fences of its ``x`` to each row, which has columns ``x`` and ``y``.

    A held table is broadcast. Otherwise the fences are repeated for each
    bucket of ``y`` that an ``x`` uses, and the join runs on both, so that the
    rows of a hot ``x`` are shuffled to many tasks.
    """
    limits = fenced.select(F.col("x").alias("__x"), "fence_low", "fence_high")
    if held:
        return rows.join(F.broadcast(limits), F.col("x") == F.col("__x")).drop("__x")
    cuts = cut_points(pairs, "y")
    used = with_bucket(pairs, "y", cuts).select("x", "__bucket").distinct()
    spread = used.join(limits, F.col("x") == F.col("__x")).drop("__x")
    return join_buckets(with_bucket(rows, "y", cuts), spread, ["x"], bounded=False)


def _fence_ranges(facts: DataFrame) -> DataFrame:
    """Add what the counts tell about the fences of each ``x``: the least and the most they can be."""
    last = F.col("__total") - 1
    group = Window.partitionBy("x")

    def ends(p: float) -> tuple[Column, Column]:
        place = F.lit(p) * last
        low = F.min(F.when(holds(F.floor(place)), F.col("__low"))).over(group)
        high = F.max(F.when(holds(F.ceil(place)), F.col("__high"))).over(group)
        return low - ROUNDING * F.abs(low), high + ROUNDING * F.abs(high)

    (q1_least, q1_most), (q3_least, q3_most) = ends(0.25), ends(0.75)
    facts = facts.withColumns({"__a": q1_least, "__b": q1_most, "__c": q3_least, "__d": q3_most})
    widest = F.lit(WHISKER) * (F.col("__d") - F.col("__a"))
    narrowest = F.lit(WHISKER) * F.greatest(F.lit(0.0), F.col("__c") - F.col("__b"))
    return facts.withColumns(
        {
            "__low_least": F.col("__a") - widest, "__low_most": F.col("__b") - narrowest,
            "__high_least": F.col("__c") + narrowest, "__high_most": F.col("__d") + widest,
        }
    ).drop("__a", "__b", "__c", "__d")


def _parted(least: Column, most: Column) -> Column:
    """Whether a fence between these limits may have values of a bucket on either side."""
    apart = (F.col("__high") < least) | (F.col("__low") > most)
    return ~apart | F.isnan(least) | F.isnan(most)


def box_stats(df: DataFrame, x: str, y: str) -> DataFrame:
    """Box plot numbers of ``y`` per ``x``: quartiles, whiskers, number of outliers.

    Whiskers end at the outermost values within 1.5 interquartile ranges. Three scans: borders
    of buckets, rows per ``x`` and bucket, and the values of the buckets that hold a quartile or may hold
    a fence. All other buckets lie within the fences or beyond, as a whole.
    """
    source, facts = bucket_facts(_pairs(df, x, y), "y", ["x"])
    facts = _fence_ranges(facts.withColumn("__want", wanted_here(QUARTILES)))
    needed = (
        (F.size("__want") > 0)
        | _parted(F.col("__low_least"), F.col("__low_most"))
        | _parted(F.col("__high_least"), F.col("__high_most"))
    )
    several = F.col("__low") < F.col("__high")
    facts = facts.withColumn("__open", needed & several)
    facts = kept(facts.drop("__low_least", "__low_most", "__high_least", "__high_most"), "boxes")
    chosen = facts.where("__open")
    held = hold(chosen)
    inner = opened(source, "y", ["x"], chosen if held is None else held, held is not None)
    pieces = kept(facts.where("NOT __open").unionAll(inner), "pieces")

    fenced, bounded = _fences(interpolated(pieces, ["x"], QUARTILES, ["q1", "median", "q3"], False))
    limits = fenced.select("x", "fence_low", "fence_high")
    if bounded:
        joined = pieces.join(F.broadcast(limits), "x")
    else:
        # Per bucket too, so that a hot x is spread.
        used = pieces.select("x", "__bucket").distinct().join(limits, "x")
        joined = join_buckets(pieces, used, ["x"], bounded=False)
    inside = (F.col("__low") >= F.col("fence_low")) & (F.col("__high") <= F.col("fence_high"))
    ends = joined.groupBy(F.col("x").alias("__x")).agg(
        F.min(F.when(inside, F.col("__low"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("__high"))).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("__in"))).alias("n_outliers"),
    )
    return ends.join(F.broadcast(fenced) if bounded else fenced, F.col("x") == F.col("__x")).select(
        "x", F.col("n").alias("count"), "q1", "median", "q3",
        "whisker_low", "whisker_high", "n_outliers",
    )


def outliers(df: DataFrame, x: str, y: str) -> DataFrame:
    """The rows of ``df`` whose ``y`` lies beyond the whiskers of its ``x``."""
    pairs = _pairs(df, x, y)
    fenced, held = _fences(quantiles(pairs, "y", QUARTILES, ["q1", "median", "q3"], keys=["x"]))
    rows = df.select(
        F.struct(*map(ref, df.columns)).alias("__row"),
        present(df, x).alias("x"),
        present(df, y).cast("double").alias("y"),
    ).dropna(subset=["x", "y"])
    joined = _against_fences(rows, pairs, fenced, held)
    beyond = (F.col("y") < F.col("fence_low")) | (F.col("y") > F.col("fence_high"))
    return joined.where(beyond).select("__row.*")


def correlation_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``x, y, n, corr`` for every ordered pair, over rows where both are present.

    A column without variation, seen over the rows of the pair, correlates as NULL, one
    with an infinite value as NaN. One scan finds the moments of all pairs, whatever their number
    (:mod:`tablecraft.functions.moments`); a second one is made only for pairs whose
    rows lie far from the means of their columns.
    """
    names = numeric_columns(df) if cols is None else require_columns(df, cols, kinds=["numeric"])[0]
    if not names:
        return local_table(df.sparkSession, [], CORRELATION_SCHEMA)
    values = {name: f"CAST({text} AS DOUBLE)" for name, text in present_sql(df, names).items()}
    n, corr = moments.correlations(df, values)
    k = len(names)
    found = pa.table(
        {
            "x": pa.array([x for x in names for _ in names]),
            "y": pa.array(names * k),
            "n": pa.array(n.ravel()),
            "corr": pa.array(corr.ravel().tolist(), pa.float64()),
        }
    )
    return df.sparkSession.createDataFrame(found).coalesce(1)
