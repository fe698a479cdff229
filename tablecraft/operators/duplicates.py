"""Counting, reporting and removing duplicate rows.

Equal rows have equal hashes, so a row whose hash occurs once is no duplicate. One pass
shuffles a hash per row and keeps the repeated ones. From these a bit filter is put together
by an aggregate and broadcast: its size does not grow with the table. Rows that do not pass
it are no duplicates and stay where they are; the others are compared in full. Up to
HELD_HASHES repeated hashes few others pass by chance; beyond, more rows are compared. Comparing is a grouped aggregate with map-side combining,
so a row that repeats in a third of the table costs one shuffled row per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.bitfilter import ROOM, passing
from tablecraft.functions.cluster import kept
from tablecraft.functions.columns import ratio, ref, require_columns

#: Repeated hashes that the filter has room for.
HELD_HASHES = ROOM


def _names(df: DataFrame, cols: Sequence[str] | None) -> list[str]:
    return list(df.columns) if cols is None else require_columns(df, cols)[0]


def _hash(names: Sequence[str]) -> Column:
    return F.xxhash64(*map(ref, names))


def _repeated_hashes(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Hashes that several rows have, from one pass over the table."""
    counted = df.groupBy(_hash(names).alias("__hash")).agg(F.count(F.lit(1)).alias("n"))
    return kept(counted.where("n > 1").select("__hash"), "repeated")


def _passing(df: DataFrame, names: Sequence[str], hashes: DataFrame, pass_on: bool) -> DataFrame:
    """Rows that may repeat another one or, without ``pass_on``, those that do not."""
    return passing(df, _hash(names), hashes, pass_on, HELD_HASHES)


def _extra(df: DataFrame, names: Sequence[str], hashes: DataFrame) -> DataFrame:
    """One row: rows in the table, and how many of them repeat an earlier one."""
    rows = _passing(df.select(*map(ref, names)), names, hashes, True)
    groups = rows.groupBy(*map(ref, names)).agg(F.count(F.lit(1)).alias("__n")).select("__n")
    none = F.lit(0).cast("long")
    extra = groups.agg(none.alias("total"), F.coalesce(F.sum(F.col("__n") - 1), none).alias("extra"))
    total = df.agg(F.count(F.lit(1)).alias("total"), none.alias("extra"))
    return total.unionAll(extra).agg(F.sum("total").alias("total"), F.sum("extra").alias("extra"))


def _extra_of(df: DataFrame, cols: Sequence[str] | None) -> DataFrame:
    names = _names(df, cols)
    return _extra(df, names, _repeated_hashes(df, names))


def count(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows that repeat an earlier one; NULLs equal each other, as do NaNs."""
    return _extra_of(df, cols).select(F.col("extra").alias("duplicate_count"))


def report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Total, unique and duplicate rows with the share in percent (2 decimals)."""
    total, extra = F.col("total"), F.col("extra")
    return _extra_of(df, cols).select(
        total.alias("total_rows"),
        (total - extra).alias("unique_rows"),
        extra.alias("duplicate_count"),
        F.round(ratio(extra, total, 0.0) * 100.0, 2).alias("duplicate_pct"),
        F.lit(", ".join(_names(df, cols))).alias("checked_cols"),
        (extra > 0).alias("has_duplicates"),
    )


def drop(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    keep_by: Sequence[str] | None = None,
    keep_last: bool = False,
) -> DataFrame:
    """Keep one row per distinct ``cols`` (default: all columns).

    ``keep_by`` names the survivor: the row lowest (``keep_last``: highest) by
    these columns, remaining columns breaking ties. Without it any one row of
    the group survives. Rows with a hash of their own are passed on unmoved.
    """
    names = _names(df, cols)
    return _dropped(df, names, keep_by, keep_last, _repeated_hashes(df, names))


def _dropped(
    df: DataFrame, names: Sequence[str], keep_by: Sequence[str] | None, keep_last: bool, hashes: DataFrame
) -> DataFrame:
    order = require_columns(df, keep_by or [])[0]
    single = _passing(df, names, hashes, False)
    return single.unionAll(_drop_compared(_passing(df, names, hashes, True), names, order, keep_last))


def _drop_compared(
    df: DataFrame, names: Sequence[str], keep_by: Sequence[str], keep_last: bool
) -> DataFrame:
    """Survivors by comparing rows in full.

    They are chosen by an aggregate that combines map side, not by ranking each
    group in one task.
    """
    rest = [c for c in df.columns if c not in names]
    if not keep_by or not rest:
        return df.dropDuplicates(list(names))
    order = list(dict.fromkeys([*keep_by, *rest]))
    packed = F.struct(*[ref(c).alias(f"k{i}") for i, c in enumerate(order)])
    pick = F.max(packed) if keep_last else F.min(packed)
    kept = df.groupBy(*map(ref, names)).agg(pick.alias("__kept"))
    place = {c: F.col(f"__kept.k{i}") for i, c in enumerate(order)}
    return kept.select(*[ref(c) if c in names else place[c].alias(c) for c in df.columns])


def _drop_report(extra_of: DataFrame) -> DataFrame:
    total, extra = F.col("total"), F.col("extra")
    return extra_of.select(
        total.alias("rows_before"),
        (total - extra).alias("rows_after"),
        extra.alias("rows_removed"),
    )


def drop_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows before, after and removed by :func:`drop`, without running it."""
    return _drop_report(_extra_of(df, cols))


def drop_with_report(
    df: DataFrame,
    cols: Sequence[str] | None = None,
    keep_by: Sequence[str] | None = None,
    keep_last: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """:func:`drop` and :func:`drop_report` from one pass over the hashes."""
    names = _names(df, cols)
    hashes = _repeated_hashes(df, names)
    return _dropped(df, names, keep_by, keep_last, hashes), _drop_report(_extra(df, names, hashes))
