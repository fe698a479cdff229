"""Tables the queries run on, derived from the given ones, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, cols: Iterable[str], digits: int = 4) -> DataFrame:
    """Round doubles for comparison; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in cols})


def gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers, with values blanked out at fixed places."""
    key = F.col("c_custkey")

    def blank(name: str, every: int):
        return F.when(key % every != 0, F.col(name)).alias(name)

    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        "c_name",
        blank("c_acctbal", 7),
        blank("c_nationkey", 13),
        blank("c_mktsegment", 11),
    )


GAPS = """
gaps AS (
  SELECT c_custkey, c_name,
         CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal,
         CASE WHEN c_custkey % 13 <> 0 THEN c_nationkey END AS c_nationkey,
         CASE WHEN c_custkey % 11 <> 0 THEN c_mktsegment END AS c_mktsegment
  FROM customer)"""


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with the segment of their customer and a yes/no target."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice"
    )
    return orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).select(
        "o_orderkey",
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("o_totalprice").alias("price"),
        (F.col("o_totalprice") > 100000).cast("int").alias("large"),
    )


SALES = """
sales AS (
  SELECT o_orderkey, c_mktsegment AS segment, o_orderpriority AS priority,
         o_totalprice AS price, CAST(o_totalprice > 100000 AS INTEGER) AS large
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items with a score, a noisy label that follows it and a prediction."""
    base = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    )
    raw = F.col("l_discount") * 5 + F.col("l_quantity") / 50
    digits = F.substring(F.md5(F.concat_ws(":", "l_orderkey", "l_linenumber")), 1, 4)
    noise = F.conv(digits, 16, 10).cast("long") % 1000
    return base.withColumns(
        {
            "score": F.round(raw, 4),
            "label": (raw + noise / F.lit(1000.0) > 0.95).cast("double"),
            "prediction": (F.round(raw, 4) > 0.75).cast("double"),
        }
    )


LINES = """
lines AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax,
         l_returnflag, l_linestatus,
         round(raw, 4) AS score,
         CAST(raw + noise / 1000.0::DOUBLE > 0.95 AS DOUBLE) AS label,
         CAST(round(raw, 4) > 0.75 AS DOUBLE) AS prediction
  FROM (SELECT *, l_discount * 5 + l_quantity / 50 AS raw,
               CAST('0x' || substr(md5(concat_ws(':', l_orderkey, l_linenumber)), 1, 4) AS BIGINT) % 1000
                 AS noise
        FROM lineitem))"""
