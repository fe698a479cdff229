"""Distributions and relations between columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.fixtures import GAPS, SALES, gaps, rounded, sales, table
from tablecraft.operators import distributions, missing, relations


@query("value_counts", "WITH " + GAPS + """
SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*) AS count FROM gaps GROUP BY ALL
UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM gaps GROUP BY ALL""")
def value_counts(spark, sf):
    return distributions.value_counts(gaps(spark, sf), ["c_mktsegment", "c_nationkey"])


@query("value_counts_by_frequency", """
SELECT 'o_orderstatus' AS "column", o_orderstatus AS value, count(*) AS count FROM orders GROUP BY ALL
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL""")
def value_counts_by_frequency(spark, sf):
    cols = ["o_orderstatus", "o_orderpriority"]
    return distributions.value_counts(table(spark, sf, "orders"), cols, dropna=True, order="count")


@query("frequencies", "WITH " + GAPS + """
SELECT 'c_mktsegment' AS "column", c_mktsegment AS value, count(*) AS count,
       round(count(*) / sum(count(*)) OVER (), 4) AS share
FROM gaps WHERE c_mktsegment IS NOT NULL GROUP BY ALL
UNION ALL
SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*), round(count(*) / sum(count(*)) OVER (), 4)
FROM gaps WHERE c_nationkey IS NOT NULL GROUP BY ALL""")
def frequencies(spark, sf):
    found = distributions.frequencies(gaps(spark, sf), ["c_mktsegment", "c_nationkey"])
    return rounded(found, ["share"])


@query("counts_by_target", "WITH " + SALES + """
SELECT segment AS x, large AS target, count(*) AS count,
       round(count(*) / sum(count(*)) OVER (PARTITION BY segment), 4) AS share
FROM sales GROUP BY segment, large""")
def counts_by_target(spark, sf):
    return rounded(relations.counts_by_target(sales(spark, sf), "segment", "large"), ["share"])


MEANS = """
  count(*) AS count, round(avg({y}), 4) AS mean, round(stddev_samp({y}), 4) AS stddev,
  round(avg({y}) - 1.96::DOUBLE * stddev_samp({y}) / sqrt(count(*)), 4) AS ci_low,
  round(avg({y}) + 1.96::DOUBLE * stddev_samp({y}) / sqrt(count(*)), 4) AS ci_high"""
MEAN_COLUMNS = ["mean", "stddev", "ci_low", "ci_high"]


@query("mean_by_groups", "WITH " + SALES + "SELECT segment AS x, priority AS hue,"
       + MEANS.format(y="price") + " FROM sales GROUP BY segment, priority")
def mean_by_groups(spark, sf):
    found = relations.mean_by_groups(sales(spark, sf), "segment", "price", "priority")
    return rounded(found, MEAN_COLUMNS)


def _drawn(uniform: str) -> str:
    share, cases = 0.0, []
    for k, p in enumerate(relations.POISSON):
        share += p
        cases.append(f"WHEN {uniform} < {share!r}::DOUBLE THEN {k}")
    return f"CASE {' '.join(cases)} ELSE {len(relations.POISSON)} END"


@query("bootstrap_mean_by_groups", "WITH " + SALES + """, rows AS (
  SELECT segment, priority, price, md5(concat_ws(':', o_orderkey, '42')) AS h FROM sales),
drawn AS (
  SELECT segment, priority, price, replicate,
         ((CAST('0x' || substr(h, 1, 8) AS BIGINT) + replicate * CAST('0x' || substr(h, 9, 8) AS BIGINT)) % 4294967296)
           / 4294967296.0::DOUBLE AS u
  FROM rows, (SELECT unnest(range(1, 51)) AS replicate)),
means AS (
  SELECT segment, priority, replicate, sum(w * price) / sum(w) AS m
  FROM (SELECT *, """ + _drawn("u") + """ AS w FROM drawn) GROUP BY ALL),
ends AS (
  SELECT segment, priority, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM means GROUP BY ALL)
SELECT segment AS x, priority AS hue, count(*) AS count, round(avg(price), 4) AS mean,
       round(any_value(lo), 4) AS ci_low, round(any_value(hi), 4) AS ci_high
FROM rows JOIN ends USING (segment, priority) GROUP BY segment, priority""")
def bootstrap_mean_by_groups(spark, sf):
    found = relations.bootstrap_mean_by_groups(
        sales(spark, sf), "segment", "price", "o_orderkey", "priority", replicates=50
    )
    return rounded(found, ["mean", "ci_low", "ci_high"])


FILLED_MEANS = "WITH " + GAPS + """,
filled AS (
  SELECT coalesce(c_acctbal, (SELECT quantile_disc(c_acctbal, 0.5) FROM gaps)) AS balance,
         coalesce(c_mktsegment, (SELECT c_mktsegment FROM gaps WHERE c_mktsegment IS NOT NULL
           GROUP BY c_mktsegment ORDER BY count(*) DESC, c_mktsegment LIMIT 1)) AS segment
  FROM gaps)
SELECT segment AS x,""" + MEANS.format(y="balance") + " FROM filled GROUP BY segment"


@query("mean_by_filled_groups", FILLED_MEANS)
def mean_by_filled_groups(spark, sf):
    customers = missing.fill_median(gaps(spark, sf), ["c_acctbal"], relative_error=0).table
    customers = missing.fill_mode(customers, ["c_mktsegment"]).table
    found = relations.mean_by_groups(customers, "c_mktsegment", "c_acctbal")
    return rounded(found, MEAN_COLUMNS)


def _boxes(source: str, x: str, y: str) -> str:
    return f"""
quartiles AS (
  SELECT {x} AS x, count(*) AS n, quantile_cont({y}, 0.25) AS q1, quantile_cont({y}, 0.5) AS median,
         quantile_cont({y}, 0.75) AS q3
  FROM {source} GROUP BY {x}),
fences AS (
  SELECT *, q1 - 1.5::DOUBLE * (q3 - q1) AS lo, q3 + 1.5::DOUBLE * (q3 - q1) AS hi FROM quartiles)"""


def _box_rows(source: str, x: str, y: str) -> str:
    return f"""
SELECT f.x, f.n AS count, round(any_value(f.q1), 4) AS q1, round(any_value(f.median), 4) AS median,
       round(any_value(f.q3), 4) AS q3,
       min({y}) FILTER ({y} BETWEEN lo AND hi) AS whisker_low,
       max({y}) FILTER ({y} BETWEEN lo AND hi) AS whisker_high,
       count(*) FILTER ({y} NOT BETWEEN lo AND hi) AS n_outliers
FROM {source} s JOIN fences f ON s.{x} = f.x GROUP BY f.x, f.n"""


@query("box_stats", "WITH " + _boxes("events", "event_type", "value")
       + _box_rows("events", "event_type", "value"))
def box_stats(spark, sf):
    found = relations.box_stats(table(spark, sf, "events"), "event_type", "value")
    return rounded(found, ["q1", "median", "q3"])


@query("box_stats_by_target", "WITH " + SALES + "," + _boxes("sales", "large", "price")
       + _box_rows("sales", "large", "price"))
def box_stats_by_target(spark, sf):
    return rounded(relations.box_stats(sales(spark, sf), "large", "price"), ["q1", "median", "q3"])


@query("outliers", "WITH " + _boxes("events", "event_type", "value") + """
SELECT event_id, user_id, event_type, value, props
FROM events JOIN fences ON event_type = x WHERE value < lo OR value > hi""")
def outliers(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", "props")
    return relations.outliers(events, "event_type", "value")


@query("histogram", """
WITH s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM events),
counted AS (
  SELECT CAST(least(floor((value - lo) / w), 29) AS INTEGER) AS bin, count(*) AS count
  FROM events, s WHERE value IS NOT NULL GROUP BY 1)
SELECT 'value' AS "column", CAST(b.bin AS INTEGER) AS bin, round(lo + b.bin * w, 4) + 0.0 AS lower,
       round(lo + (b.bin + 1) * w, 4) + 0.0 AS upper, coalesce(c.count, 0) AS count
FROM (SELECT unnest(range(30)) AS bin) b CROSS JOIN s LEFT JOIN counted c ON c.bin = b.bin""")
def histogram(spark, sf):
    found = distributions.histogram(table(spark, sf, "events"), ["value"])
    return rounded(found, ["lower", "upper"])


@query("histogram_all", "\nUNION ALL ".join(f"""
(WITH s AS (SELECT CAST(min({c}) AS DOUBLE) AS lo, (max({c}) - min({c}))::DOUBLE / 30 AS w FROM lineitem),
counted AS (
  SELECT CAST(least(floor(({c}::DOUBLE - lo) / w), 29) AS INTEGER) AS bin, count(*) AS count
  FROM lineitem, s GROUP BY 1)
SELECT '{c}' AS "column", CAST(b.bin AS INTEGER) AS bin, coalesce(c.count, 0) AS count
FROM (SELECT unnest(range(30)) AS bin) b LEFT JOIN counted c ON c.bin = b.bin)"""
    for c in ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
              "l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def histogram_all(spark, sf):
    return distributions.histogram(table(spark, sf, "lineitem")).select("column", "bin", "count")


@query("histogram_gaps", "WITH " + GAPS + """,
s AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 30 AS w FROM gaps),
counted AS (
  SELECT CAST(least(floor((c_acctbal - lo) / w), 29) AS INTEGER) AS bin, count(*) AS count
  FROM gaps, s WHERE c_acctbal IS NOT NULL GROUP BY 1)
SELECT 'c_acctbal' AS "column", CAST(b.bin AS INTEGER) AS bin, coalesce(c.count, 0) AS count
FROM (SELECT unnest(range(30)) AS bin) b LEFT JOIN counted c ON c.bin = b.bin""")
def histogram_gaps(spark, sf):
    found = distributions.histogram(gaps(spark, sf), ["c_acctbal"])
    return found.select("column", "bin", "count")


@query("kde", """
WITH s AS (SELECT min(value) AS lo, (max(value) - min(value)) / 199 AS step, count(value) AS n,
                  stddev_samp(value) * pow(count(value), -0.2::DOUBLE) AS h FROM events),
grid AS (SELECT lo + g * step AS x FROM (SELECT unnest(range(200)) AS g), s)
SELECT 'value' AS "column", round(x, 4) + 0.0 AS x,
       round(sum(exp(-0.5::DOUBLE * pow((x - value) / h, 2))) / any_value(n * h * sqrt(2 * pi())), 6) + 0.0
         AS density
FROM grid CROSS JOIN events CROSS JOIN s GROUP BY x""")
def kde(spark, sf):
    found = distributions.kde(table(spark, sf, "events"), ["value"])
    return rounded(rounded(found, ["x"]), ["density"], 6)


def _correlations(source: str, names) -> str:
    return "\nUNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, count(*) FILTER ({a} IS NOT NULL AND {b} IS NOT NULL) AS n, "
        f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE round(corr({a}, {b}), 4) + 0.0 END AS corr "
        f"FROM {source}"
        for a in names for b in names
    )


@query("correlation_matrix", _correlations(
    "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))
def correlation_matrix(spark, sf):
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    return rounded(relations.correlation_matrix(table(spark, sf, "lineitem"), cols), ["corr"])


WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "net", "charged", "fixed"]


@query("correlation_matrix_wide", """
WITH w AS (
  SELECT *, l_extendedprice * (1 - l_discount) AS net,
         CASE WHEN l_returnflag <> 'R' THEN l_extendedprice * (1 + l_tax) END AS charged,
         1::BIGINT AS fixed
  FROM lineitem)
""" + _correlations("w", WIDE))
def correlation_matrix_wide(spark, sf):
    price = F.col("l_extendedprice")
    wide = table(spark, sf, "lineitem").withColumns(
        {
            "net": price * (1 - F.col("l_discount")),
            "charged": F.when(F.col("l_returnflag") != "R", price * (1 + F.col("l_tax"))),
            "fixed": F.lit(1).cast("long"),
        }
    )
    return rounded(relations.correlation_matrix(wide, WIDE), ["corr"])


@query("correlation_matrix_gaps", "WITH " + GAPS + ", g AS (SELECT *, 1::BIGINT AS fixed FROM gaps)"
       + _correlations("g", ["c_custkey", "c_acctbal", "c_nationkey", "fixed"]))
def correlation_matrix_gaps(spark, sf):
    customers = gaps(spark, sf).withColumn("fixed", F.lit(1).cast("long"))
    return rounded(relations.correlation_matrix(customers), ["corr"])


SHIFTED = """
shifted AS (
  SELECT CASE WHEN l_orderkey % 5 <> 0 THEN CAST(l_partkey % 7 AS DOUBLE) END AS b,
         CASE WHEN l_orderkey % 5 <> 0 THEN 1e7 + (l_partkey % 7) * 0.1 ELSE l_extendedprice * 1e4 END AS a,
         {rest}
  FROM lineitem)"""
ELEVEN = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
          "l_linenumber", "l_orderkey", "net"]


def _shifted(spark, sf):
    """Two columns that agree where both are present, one of them far away elsewhere."""
    there = F.col("l_orderkey") % 5 != 0
    rest = (F.col("l_partkey") % 7).cast("double")
    return table(spark, sf, "lineitem").withColumns(
        {
            "b": F.when(there, rest),
            "a": F.when(there, F.lit(1e7) + rest * 0.1).otherwise(F.col("l_extendedprice") * 1e4),
            "net": F.col("l_extendedprice") * (1 - F.col("l_discount")),
        }
    )


@query("correlation_shifted_two", "WITH " + SHIFTED.format(rest="1 AS one") + _correlations("shifted", ["a", "b"]))
def correlation_shifted_two(spark, sf):
    return rounded(relations.correlation_matrix(_shifted(spark, sf), ["a", "b"]), ["corr"])


@query("correlation_shifted_eleven", "WITH "
       + SHIFTED.format(rest="lineitem.*, l_extendedprice * (1 - l_discount) AS net")
       + _correlations("shifted", ["a", "b", *ELEVEN]))
def correlation_shifted_eleven(spark, sf):
    return rounded(relations.correlation_matrix(_shifted(spark, sf), ["a", "b", *ELEVEN]), ["corr"])
