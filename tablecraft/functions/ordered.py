"""Running totals and exact ranks without a single-task sort.

A plain ``sum() over (order by x)`` moves the whole table into one task. Here
the values are first cut into many ordered buckets of about equal size; totals
run inside each bucket in parallel, and a small table with one row per bucket
supplies what came before. Cut points only decide how even the buckets are:
results are exact for any cut points.

Values are grouped before they are ranked, so one that repeats any number of
times is one row, and a group holding most of the table is spread over all buckets.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.bitfilter import passing
from tablecraft.functions.cluster import kept, local_table
from tablecraft.functions.columns import dtype_of, ref
from tablecraft.functions.texts import split_texts

#: Upper bound of the bucket tables that are broadcast or ranked in one task.
MAX_BUCKETS = 10_000
#: Share of the rows that cut points are estimated from.
CUT_SHARE = 0.02
#: Rows of a per-group table that may be held by the driver and broadcast.
HELD_ROWS = 20_000
#: Characters of text per row, on average, in a table held by the driver.
HELD_TEXT = 1_000


def default_buckets(df: DataFrame) -> int:
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(128, min(MAX_BUCKETS, 4 * shuffle))


def cut_points(df: DataFrame, value: str, buckets: int | None = None) -> list:
    """Ordered inner bucket borders of a column (one job, bounded result).

    They are estimated from a share of the rows, as for any range partitioning.
    A small table may get few borders or none, and then needs none. A value that takes up
    several of them gets a bucket of its own, so that counting a bucket says all about it.
    """
    if isinstance(dtype_of(df, value), T.NumericType):
        count = buckets or default_buckets(df)
        shares = [i / count for i in range(1, count)]
        seen = df.select(ref(value).alias("value")).sample(CUT_SHARE, seed=7)
        found = seen.approxQuantile("value", shares, 1.0 / (4 * count))
        often = {c for c, n in Counter(found).items() if n > 1}
        ends = {math.nextafter(c, math.inf) for c in often}
        return sorted({c for c in ends.union(found) if math.isfinite(c)})
    raise TypeError(f"{value} has no numeric scale")


def with_bucket(df: DataFrame, value: str, cuts: Sequence, out: str = "__bucket") -> DataFrame:
    """Add the number of cut points at or below the value."""
    if not cuts:
        return df.withColumn(out, F.lit(0))
    binner = Bucketizer(
        splits=[-math.inf, *cuts, math.inf], inputCol=value, outputCol=out, handleInvalid="keep"
    )
    # Values are never missing here; saying so keeps joins from testing the bucket again.
    return binner.transform(df).withColumn(out, F.coalesce(F.col(out).cast("int"), F.lit(0)))


def _bucketed(df: DataFrame, value: str, cuts: Sequence | None) -> DataFrame:
    """Distinct values with the number of their ordered bucket, for any type that has an order."""
    dtype = dtype_of(df, value)
    if isinstance(dtype, T.NumericType):
        return with_bucket(df, value, cut_points(df, value) if cuts is None else cuts)
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return split_texts(df, value, df.count())
    number = F.unix_micros(ref(value)) if isinstance(dtype, T.TimestampType) else (
        ref(value).cast("int") if isinstance(dtype, T.BooleanType) else F.unix_date(ref(value).cast("date"))
    )
    rows = df.withColumn("__number", number.cast("double"))
    return with_bucket(rows, "__number", cut_points(rows, "__number")).drop("__number")


def small_rows(df: DataFrame, limit: int, characters: int | None = None) -> list | None:
    """All rows if there are at most ``limit`` with at most ``characters`` of text in all, else None.

    Numbers and lengths are checked first, over no more rows than the limit and one,
    so that the driver never gets more than that. A single long text is no obstacle.
    """
    characters = limit * HELD_TEXT if characters is None else characters
    few = df.limit(limit + 1)
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if texts:
        size = sum((F.coalesce(F.length(ref(c)), F.lit(0)) for c in texts), F.lit(0)).cast("long")
        held = few.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("size")).first()
        if held["n"] > limit or (held["size"] or 0) > characters:
            return None
    rows = [tuple(row) for row in few.collect()]
    return None if len(rows) > limit else rows


def hold(df: DataFrame, limit: int = HELD_ROWS) -> DataFrame | None:
    """The table as a driver-side one if it is small, else None."""
    rows = small_rows(df, limit)
    return None if rows is None else local_table(df.sparkSession, rows, df.schema)


def join_buckets(
    rows: DataFrame, small: DataFrame, keys: Sequence[str], bounded: bool
) -> DataFrame:
    """Join rows with per-(keys, bucket) facts; NULL keys match each other.

    ``bounded`` says that the facts have a known small size and are broadcast:
    one row per bucket, or a table from :func:`hold`. Otherwise both sides are
    shuffled by keys and bucket, which spreads a hot key.
    """
    names = [*keys, "__bucket"]
    right = small.withColumnsRenamed({name: f"__r_{name}" for name in names})
    condition = rows["__bucket"] == right["__r___bucket"]
    for key in keys:
        condition = condition & rows[key].eqNullSafe(right[f"__r_{key}"])
    joined = rows.join(F.broadcast(right) if bounded else right, condition, "inner")
    return joined.drop(*[f"__r_{n}" for n in names])


def running_totals(
    df: DataFrame,
    value: str,
    totals: Sequence[str],
    descending: bool = False,
    cuts: Sequence | None = None,
) -> DataFrame:
    """Add per total ``cum_<t>``, its sum up to and including this row, and ``all_<t>``.

    ``df`` has one row per distinct, non-null ``value``.
    """
    rows = _bucketed(df, value, cuts)
    order = F.desc if descending else F.asc
    # One row per bucket, so ranking the buckets in one task is cheap.
    before = Window.orderBy(order("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy("__bucket").agg(*[F.sum(t).alias(f"all_{t}") for t in totals])
    offsets = offsets.select(
        "__bucket",
        *[F.coalesce(F.sum(f"all_{t}").over(before), F.lit(0)).alias(f"__o_{t}") for t in totals],
        *[F.sum(f"all_{t}").over(Window.partitionBy()).alias(f"all_{t}") for t in totals],
    )
    inside = (
        Window.partitionBy("__bucket")
        .orderBy(order(value))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = join_buckets(rows, offsets, [], bounded=True)
    out = joined.withColumns(
        {f"cum_{t}": F.sum(t).over(inside) + F.col(f"__o_{t}") for t in totals}
    )
    return out.drop(*[f"__o_{t}" for t in totals])


def _wanted_ranks(probabilities: Sequence[float], total: Column, discrete: bool) -> list[Column]:
    ranks = []
    for i, p in enumerate(probabilities):
        if discrete:
            low = F.greatest(F.ceil(F.lit(p) * total) - 1, F.lit(0))
            high = low
        else:
            place = F.lit(p) * (total - 1)
            low, high = F.floor(place), F.ceil(place)
        for side, rank in (("lo", low), ("hi", high)):
            ranks.append(
                F.struct(F.lit(f"{side}{i}").alias("side"), rank.cast("long").alias("rank"))
            )
    return ranks


def holds(rank: Column) -> Column:
    """Whether the rows of a bucket, or of a value in it, include the one of this rank."""
    return (rank >= F.col("__before")) & (rank < F.col("__before") + F.col("__in"))


def bucket_facts(df: DataFrame, value: str, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with their buckets, and per group and bucket ``__in, __low, __high, __before, __total``.

    These are the number of rows, the lowest and highest value, the rows of the group in lower buckets and
    those in all. One scan finds the borders, another one counts when the facts are read.
    """
    source = df.select(*keys, value).where(F.col(value).isNotNull())
    source = with_bucket(source, value, cut_points(source, value))
    group = Window.partitionBy(*keys)
    lower = group.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    facts = source.groupBy(*keys, "__bucket").agg(
        F.count(F.lit(1)).alias("__in"), F.min(value).alias("__low"), F.max(value).alias("__high")
    )
    return source, facts.withColumns(
        {
            "__before": F.coalesce(F.sum("__in").over(lower), F.lit(0)),
            "__total": F.sum("__in").over(group),
        }
    )


def opened(source: DataFrame, value: str, keys: Sequence[str], facts: DataFrame, bounded: bool) -> DataFrame:
    """``facts`` per value instead of per bucket: ``__low`` and ``__high`` are the value.

    ``bounded`` says that the facts have a known small size: they are broadcast, and rows are counted
    where they lie. Otherwise rows that a bit filter of the buckets lets pass are shuffled once, by
    group and bucket; all that follows keeps this partitioning. A value frequent enough to
    make such a partition large has a bucket of its own and is never opened.
    """
    # The same type on both sides, or Spark casts one and loses the partitioning.
    names = [*keys, "__bucket"]
    place = F.struct(*names).cast(T.StructType([T.StructField(c, facts.schema[c].dataType) for c in names]))
    rest = [c for c in facts.columns if c not in (*names, "__in", "__low", "__high")]
    known = facts.select(place.alias("__place"), F.struct(*rest).alias("__facts"))
    rows = source.select(place.alias("__place"), value)
    if not bounded:
        hashes = known.select(F.xxhash64("__place").alias("__hash"))
        rows = passing(rows, F.xxhash64("__place"), hashes)
    # NULL keys are equal inside a struct.
    met = rows.join(F.broadcast(known) if bounded else known.hint("merge"), "__place")
    counted = met.groupBy("__place", value).agg(
        F.count(F.lit(1)).alias("__in"), F.any_value("__facts").alias("__facts")
    )
    lower = Window.partitionBy("__place").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("__facts.__before") + F.coalesce(F.sum("__in").over(lower), F.lit(0))
    found = {c: before if c == "__before" else F.col(f"__facts.{c}") for c in rest}
    found |= {"__in": F.col("__in"), "__low": F.col(value), "__high": F.col(value)}
    found |= {c: F.col("__place")[c] for c in names}
    return counted.select(*[found[c].alias(c) for c in facts.columns])


def interpolated(
    pieces: DataFrame, keys: Sequence[str], probabilities: Sequence[float], names: Sequence[str], discrete: bool
) -> DataFrame:
    """``keys..., n, names...`` from pieces of one value each that hold the ranks in their ``__want``."""
    hits = pieces.select(
        *keys,
        "__low",
        "__total",
        F.explode(F.filter("__want", lambda t: holds(t["rank"]))).alias("__hit"),
    )
    sides = [
        F.max(F.when(F.col("__hit.side") == f"{side}{i}", F.col("__low"))).alias(f"__{side}{i}")
        for i in range(len(probabilities))
        for side in ("lo", "hi")
    ]
    picked = hits.groupBy(*keys).agg(F.max("__total").alias("n"), *sides)
    results = []
    for i, (p, name) in enumerate(zip(probabilities, names)):
        low = F.col(f"__lo{i}")
        if discrete:
            results.append(low.alias(name))
            continue
        place = F.lit(p) * (F.col("n") - 1)
        low, high = low.cast("double"), F.col(f"__hi{i}").cast("double")
        results.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return picked.select(*keys, "n", *results)


def wanted_here(probabilities: Sequence[float], discrete: bool = False) -> Column:
    """The ranks that these probabilities ask for and that a row of the facts holds."""
    ranks = F.array(*_wanted_ranks(probabilities, F.col("__total"), discrete))
    return F.filter(ranks, lambda t: holds(t["rank"]))


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    names: Sequence[str],
    keys: Sequence[str] = (),
    discrete: bool = False,
) -> DataFrame:
    """Exact quantiles of ``value`` per group: ``keys..., n, names...``.

    Linear interpolation between neighbours, or with ``discrete`` the lowest
    value whose cumulative share reaches the probability, in its own type.
    NULLs are ignored; NaN must have been turned into NULL.

    Rows are first only counted per group and bucket. Those counts tell which
    buckets hold the wanted ranks, and only these few are sorted, unless they have a single
    value. Three scans, whatever the number of groups.
    """
    keys = list(keys)
    source, facts = bucket_facts(df, value, keys)
    facts = facts.withColumn("__want", wanted_here(probabilities, discrete)).where(F.size("__want") > 0)
    facts.persist()
    try:
        held = hold(facts)
        wanted = kept(facts, "ranks") if held is None else held
    finally:
        facts.unpersist()
    several = F.col("__low") < F.col("__high")
    inner = opened(source, value, keys, wanted.where(several), held is not None)
    return interpolated(wanted.where(~several).unionAll(inner), keys, probabilities, names, discrete)
