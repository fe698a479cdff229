"""Turn column-at-a-time questions into one pass over the table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.cluster import local_table
from tablecraft.functions.columns import literal, present_sql, quoted, ref

#: Columns aggregated together; wider tables take one scan per block of this
#: size, which keeps the generated aggregation code within the JVM's limits.
COLUMNS_PER_PASS = 200


def per_column(
    df: DataFrame,
    stats: Mapping[str, Mapping[str, str]],
    schema: str,
    block: int = COLUMNS_PER_PASS,
) -> DataFrame:
    """Evaluate aggregates for many columns and return one row per column.

    ``stats`` maps column name -> statistic name -> aggregate as SQL text; all
    columns share the same statistic names. One global aggregate (partial on
    the executors, one row per task shuffled) answers a whole block. ``schema``
    describes the result when there are no columns.
    """
    names = list(stats)
    if not names:
        return local_table(df.sparkSession, [], schema)
    parts = []
    for start in range(0, len(names), block):
        chunk = list(enumerate(names[start : start + block]))
        wide = df.selectExpr(
            *[f"{text} AS c{i}_{stat}" for i, name in chunk for stat, text in stats[name].items()]
        )
        rows = []
        for i, name in chunk:
            fields = ", ".join(f"c{i}_{stat} AS `{stat}`" for stat in stats[name])
            rows.append(f"struct({literal(name)} AS `column`, {fields})")
        parts.append(wide.selectExpr(f"inline(array({', '.join(rows)}))"))
    return reduce(DataFrame.unionAll, parts)


def melt(df: DataFrame, cols: Sequence[str], dropna: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """Long form ``column, v0, v1, ...`` with one value slot per distinct type.

    Values keep their own type, so counts and orderings stay native; the
    returned mapping tells the slot of each column. NaN counts as missing.
    """
    slots: dict[str, str] = {}
    types: dict[str, str] = {}
    by_name = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    for name in cols:
        slots[name] = types.setdefault(by_name[name], f"v{len(types)}")
    values = present_sql(df, cols)
    if len(types) == 1:
        plain = df.selectExpr(*[f"{values[name]} AS {quoted(name)}" for name in cols])
        long = plain.unpivot([], [ref(name) for name in cols], "column", "v0")
    else:
        packed = []
        for i, name in enumerate(cols):
            fields = ", ".join(
                f"{values[name]} AS {slot}" if slots[name] == slot else f"CAST(NULL AS {dtype}) AS {slot}"
                for dtype, slot in types.items()
            )
            packed.append(f"struct({literal(name)} AS `column`, {fields}) AS p{i}")
        rows = df.selectExpr(*packed)
        long = rows.unpivot([], rows.columns, "place", "row").select("row.*")
    if dropna:
        long = long.where(reduce(or_, [F.col(slot).isNotNull() for slot in types.values()]))
    return long, slots


def as_text(slots: Sequence[str]) -> Column:
    """The one filled slot of a melted row as a string."""
    return F.coalesce(*[F.col(s).cast("string") for s in dict.fromkeys(slots)])
