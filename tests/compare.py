"""Compare a Spark result with a DuckDB result: names, types and all values, in any row order."""

from __future__ import annotations

import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "boolean": "BOOLEAN", "float": "FLOAT",
}


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return value


def difference(frame, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    result = con.sql(sql)
    want_types = dict(zip(result.columns, map(str, result.types)))
    got_types = {n: TYPES.get(t, t) for n, t in frame.dtypes}
    if want_types != got_types:
        return f"schema: spark {got_types} sql {want_types}"
    names = sorted(got_types)
    places = [result.columns.index(n) for n in names]
    want = Counter(tuple(_cell(row[p]) for p in places) for row in result.fetchall())
    got = Counter(tuple(_cell(row[n]) for n in names) for row in frame.collect())
    if want == got:
        return None
    return (
        f"{sum(got.values())} rows against {sum(want.values())}; "
        f"only spark {list((got - want).items())[:4]}; only sql {list((want - got).items())[:4]}"
    )
