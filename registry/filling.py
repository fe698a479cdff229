"""Missing values, duplicates and the preparation flow."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.fixtures import GAPS, gaps, rounded, table
from tablecraft.operators import duplicates, missing
from tablecraft.plans import preparation

GAP_COLUMNS = ["c_custkey", "c_name", "c_acctbal", "c_nationkey", "c_mktsegment"]
NUMBERS = ["c_acctbal", "c_nationkey"]


def _each(template: str) -> str:
    return "WITH " + GAPS + "\nUNION ALL ".join(template.format(c=c) for c in GAP_COLUMNS)


@query("missing_counts", _each(
    """SELECT '{c}' AS "column", count(*) - count({c}) AS null_count FROM gaps"""))
def missing_counts(spark, sf):
    return missing.counts(gaps(spark, sf))


@query("missing_percentages", _each(
    """SELECT '{c}' AS "column", round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 4) AS null_pct
  FROM gaps"""))
def missing_percentages(spark, sf):
    return rounded(missing.percentages(gaps(spark, sf)), ["null_pct"])


@query("missing_report", _each(
    """SELECT '{c}' AS "column", count(*) AS total_rows, count(*) - count({c}) AS null_count,
  0::BIGINT AS nan_count, round((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS null_pct,
  count(*) > count({c}) AS has_missing FROM gaps"""))
def missing_report(spark, sf):
    return missing.report(gaps(spark, sf))


@query("fill_mean", "WITH " + GAPS + """
SELECT c_custkey, c_name,
       round(coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM gaps)), 4) AS c_acctbal,
       coalesce(c_nationkey, (SELECT CAST(trunc(avg(c_nationkey)) AS INTEGER) FROM gaps)) AS c_nationkey,
       c_mktsegment
FROM gaps""")
def fill_mean(spark, sf):
    return rounded(missing.fill_mean(gaps(spark, sf), NUMBERS).table, ["c_acctbal"])


@query("fill_mean_report", "WITH " + GAPS + """
SELECT 'fill_mean' AS step, 'c_acctbal' AS "column", 'filled' AS status,
       round(avg(c_acctbal), 4) AS value FROM gaps
UNION ALL SELECT 'fill_mean', 'c_nationkey', 'filled', round(avg(c_nationkey), 4) FROM gaps""")
def fill_mean_report(spark, sf):
    told = missing.fill_mean(gaps(spark, sf), NUMBERS).report
    return told.withColumn("value", F.col("value").cast("double"))


@query("fill_checked_columns", "WITH " + GAPS + """
SELECT 'fill_mean' AS step, 'c_acctbal' AS "column", 'filled' AS status, round(avg(c_acctbal), 4) AS value FROM gaps
UNION ALL SELECT 'fill_mean', 'c_mktsegment', 'ignored', NULL
UNION ALL SELECT 'fill_mean', 'no such column', 'ignored', NULL
UNION ALL SELECT 'left', 'c_acctbal', 'missing', 0
UNION ALL SELECT 'left', 'c_mktsegment', 'missing', count(*) FILTER (c_mktsegment IS NULL) FROM gaps""")
def fill_checked_columns(spark, sf):
    """Columns that are absent or of another type are reported, and the table keeps them as they are."""
    wanted = ["c_acctbal", "c_mktsegment", "no such column"]
    filled, told = missing.fill_mean(gaps(spark, sf), wanted, strict=False)
    left = missing.counts(filled).where(F.col("column").isin(wanted)).select(
        F.lit("left").alias("step"), "column", F.lit("missing").alias("status"), F.col("null_count").cast("double").alias("value")
    )
    return told.withColumn("value", F.col("value").cast("double")).unionAll(left)


@query("fill_median", "WITH " + GAPS + """
SELECT c_custkey, c_name,
       coalesce(c_acctbal, (SELECT quantile_disc(c_acctbal, 0.5) FROM gaps)) AS c_acctbal,
       coalesce(c_nationkey, (SELECT quantile_disc(c_nationkey, 0.5) FROM gaps)) AS c_nationkey,
       c_mktsegment
FROM gaps""")
def fill_median(spark, sf):
    return missing.fill_median(gaps(spark, sf), NUMBERS, relative_error=0).table


@query("fill_median_sketch")
def fill_median_sketch(spark, sf):
    return missing.fill_median(gaps(spark, sf), NUMBERS).table


WIDE_TYPES = {
    "longs": "9007199254740993 + l_orderkey * 3",
    "far": "4611686018427387904 + l_partkey",
    "prices": "CAST(12345678901234567000 AS DECIMAL(30,2)) + CAST(l_extendedprice AS DECIMAL(12,2))",
    "plain": "l_extendedprice",
}


@query("fill_median_wide_types", "\nUNION ALL ".join(
    f"SELECT '{name}' AS \"column\", count(*) FILTER (l_orderkey % 7 <> 0) AS n, true AS own, true AS within FROM lineitem"
    for name in WIDE_TYPES))
def fill_median_wide_types(spark, sf):
    """Medians of the default 1 % of columns whose values share doubles, held against the ranks of all rows."""
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey % 7 = 0 AS gap",
        *[f"CASE WHEN l_orderkey % 7 <> 0 THEN {text} END AS {name}" for name, text in WIDE_TYPES.items()],
    )
    filled = missing.fill_median(lines, list(WIDE_TYPES)).table
    # Rows of a gap hold the median only.
    medians = filled.where("gap").first()
    held = {c: F.lit(medians[c]).cast(filled.schema[c].dataType) for c in WIDE_TYPES}
    rows = lines.where(~F.col("gap"))
    parts = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("n"),
            (F.count_if(F.col(c) == held[c]) > 0).alias("own"),
            (
                (F.count_if(F.col(c) < held[c]) <= 0.51 * F.count(c))
                & (F.count_if(F.col(c) <= held[c]) >= 0.49 * F.count(c))
            ).alias("within"),
        ).alias(c)
        for c in WIDE_TYPES
    ]
    return rows.agg(F.array(*parts).alias("all")).selectExpr("inline(all)")


def _mode(column: str) -> str:
    return (
        f"(SELECT {column} FROM gaps WHERE {column} IS NOT NULL "
        f"GROUP BY {column} ORDER BY count(*) DESC, {column} LIMIT 1)"
    )


@query("fill_mode", "WITH " + GAPS + f"""
SELECT c_custkey, c_name,
       coalesce(c_acctbal, {_mode("c_acctbal")}) AS c_acctbal,
       coalesce(c_nationkey, {_mode("c_nationkey")}) AS c_nationkey,
       coalesce(c_mktsegment, {_mode("c_mktsegment")}) AS c_mktsegment
FROM gaps""")
def fill_mode(spark, sf):
    return missing.fill_mode(gaps(spark, sf), [*NUMBERS, "c_mktsegment"]).table


@query("fill_values", "WITH " + GAPS + """
SELECT c_custkey, c_name, coalesce(c_acctbal, 0.5) AS c_acctbal,
       coalesce(c_nationkey, -1) AS c_nationkey, coalesce(c_mktsegment, 'NONE') AS c_mktsegment
FROM gaps""")
def fill_values(spark, sf):
    values = {"c_acctbal": 0.5, "c_nationkey": -1, "c_mktsegment": "NONE"}
    return missing.fill_values(gaps(spark, sf), values).table


COMPLETE = "c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL"


@query("drop_rows", "WITH " + GAPS + f"SELECT * FROM gaps WHERE {COMPLETE}")
def drop_rows(spark, sf):
    return missing.drop_rows(gaps(spark, sf))


@query("drop_rows_subset", "WITH " + GAPS + "SELECT * FROM gaps WHERE c_acctbal IS NOT NULL")
def drop_rows_subset(spark, sf):
    return missing.drop_rows(gaps(spark, sf), ["c_acctbal"])


@query("drop_rows_report", "WITH " + GAPS + f"""
SELECT count(*) AS rows_before, count(*) FILTER ({COMPLETE}) AS rows_after,
       count(*) - count(*) FILTER ({COMPLETE}) AS rows_dropped FROM gaps""")
def drop_rows_report(spark, sf):
    return missing.drop_rows_report(gaps(spark, sf))


def _pairs(spark, sf):
    return table(spark, sf, "orders").select("o_orderstatus", "o_orderpriority")


@query("duplicate_count", """
SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders))
  AS duplicate_count FROM orders""")
def duplicate_count(spark, sf):
    return duplicates.count(_pairs(spark, sf))


@query("duplicate_count_wide", """
SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS duplicate_count
FROM lineitem""")
def duplicate_count_wide(spark, sf):
    return duplicates.count(table(spark, sf, "lineitem"))


@query("duplicate_report", """
SELECT t AS total_rows, u AS unique_rows, t - u AS duplicate_count,
       round((t - u) * 100.0::DOUBLE / t, 2) AS duplicate_pct, 'text' AS checked_cols,
       t > u AS has_duplicates
FROM (SELECT count(*) AS t, count(DISTINCT text) AS u FROM documents)""")
def duplicate_report(spark, sf):
    return duplicates.report(table(spark, sf, "documents"), ["text"])


@query("drop_duplicates", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def drop_duplicates(spark, sf):
    return duplicates.drop(_pairs(spark, sf))


@query("drop_duplicates_subset", """
SELECT doc_id, text, lang, source, n_chars
FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS place FROM documents)
WHERE place = 1""")
def drop_duplicates_subset(spark, sf):
    return duplicates.drop(table(spark, sf, "documents"), ["text"], keep_by=["doc_id"])


@query("duplicate_report_many", """
SELECT count(*) AS total_rows, count(DISTINCT l_orderkey) AS unique_rows,
       count(*) - count(DISTINCT l_orderkey) AS duplicate_count,
       round((count(*) - count(DISTINCT l_orderkey)) * 100.0::DOUBLE / count(*), 2) AS duplicate_pct,
       'l_orderkey' AS checked_cols, count(*) > count(DISTINCT l_orderkey) AS has_duplicates
FROM lineitem""")
def duplicate_report_many(spark, sf):
    """Nearly every value repeats: 130 000 of them at sf0.1."""
    return duplicates.report(table(spark, sf, "lineitem"), ["l_orderkey"])


@query("drop_duplicates_many", """
SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) = 1""")
def drop_duplicates_many(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return duplicates.drop(lines, ["l_orderkey"], keep_by=["l_linenumber"])


@query("drop_duplicates_report", """
SELECT count(*) AS rows_before, count(DISTINCT text) AS rows_after,
       count(*) - count(DISTINCT text) AS rows_removed FROM documents""")
def drop_duplicates_report(spark, sf):
    return duplicates.drop_report(table(spark, sf, "documents"), ["text"])


PREPARE = [
    ("fill_median", {"cols": ["c_acctbal"], "relative_error": 0}),
    ("fill_mode", {"cols": ["c_mktsegment"]}),
    ("drop_rows", {}),
    ("drop_duplicates", {"cols": ["c_mktsegment", "c_nationkey"], "keep_by": ["c_custkey"]}),
    ("label_encode", {"cols": ["c_mktsegment"]}),
    ("minmax_scale", {"cols": ["c_acctbal"], "as_columns": True}),
]


def _prepared(spark, sf):
    return preparation.run(gaps(spark, sf), PREPARE, write_after=["drop_duplicates"])


@query("prepare_flow", "WITH " + GAPS + f""",
filled AS (
  SELECT c_custkey, c_name,
         coalesce(c_acctbal, (SELECT quantile_disc(c_acctbal, 0.5) FROM gaps)) AS c_acctbal,
         c_nationkey, coalesce(c_mktsegment, {_mode("c_mktsegment")}) AS c_mktsegment
  FROM gaps),
kept AS (
  SELECT * EXCLUDE (place) FROM (
    SELECT *, row_number() OVER (PARTITION BY c_mktsegment, c_nationkey ORDER BY c_custkey) AS place
    FROM filled WHERE c_nationkey IS NOT NULL)
  WHERE place = 1)
SELECT c_custkey, c_name, c_acctbal, c_nationkey,
       CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS c_mktsegment,
       round((c_acctbal - min(c_acctbal) OVER ()) / (max(c_acctbal) OVER () - min(c_acctbal) OVER ()), 4)
         + 0.0 AS c_acctbal_minmax
FROM kept""")
def prepare_flow(spark, sf):
    return rounded(_prepared(spark, sf).table, ["c_acctbal_minmax"])


@query("prepare_flow_report", "WITH " + GAPS + f""",
filled AS (
  SELECT c_nationkey, coalesce(c_mktsegment, {_mode("c_mktsegment")}) AS c_mktsegment FROM gaps),
whole AS (SELECT * FROM filled WHERE c_nationkey IS NOT NULL),
sizes AS (
  SELECT (SELECT count(*) FROM filled) AS a, (SELECT count(*) FROM whole) AS b,
         (SELECT count(DISTINCT (c_mktsegment, c_nationkey)) FROM whole) AS c)
SELECT 1 AS number, 'fill_median' AS step, 'c_acctbal' AS "column", 'filled' AS status,
       CAST(quantile_disc(c_acctbal, 0.5) AS VARCHAR) AS value FROM gaps
UNION ALL SELECT 2, 'fill_mode', 'c_mktsegment', 'filled', {_mode("c_mktsegment")}
UNION ALL SELECT 3, 'drop_rows', NULL, 'rows_before', CAST(a AS VARCHAR) FROM sizes
UNION ALL SELECT 3, 'drop_rows', NULL, 'rows_after', CAST(b AS VARCHAR) FROM sizes
UNION ALL SELECT 3, 'drop_rows', NULL, 'rows_dropped', CAST(a - b AS VARCHAR) FROM sizes
UNION ALL SELECT 4, 'drop_duplicates', NULL, 'rows_before', CAST(b AS VARCHAR) FROM sizes
UNION ALL SELECT 4, 'drop_duplicates', NULL, 'rows_after', CAST(c AS VARCHAR) FROM sizes
UNION ALL SELECT 4, 'drop_duplicates', NULL, 'rows_removed', CAST(b - c AS VARCHAR) FROM sizes
UNION ALL SELECT 5, 'label_encode', 'c_mktsegment', 'encoded', NULL
UNION ALL SELECT 6, 'minmax_scale', 'c_acctbal', 'scaled', NULL""")
def prepare_flow_report(spark, sf):
    return _prepared(spark, sf).report
