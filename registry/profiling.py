"""Sources, shape, schema and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry import query
from registry.fixtures import GAPS, SALES, gaps, rounded, sales, table
from tablecraft.functions.cluster import fresh_path
from tablecraft.operators import profile
from tablecraft.plans import profiling
from tablecraft.sources.tables import read_table, write_table

ORDERS = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority
FROM orders"""
ORDER_COLUMNS = (
    "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate string, o_orderpriority string"
)


ORDER_TYPES = ORDER_COLUMNS.replace("o_orderdate string", "o_orderdate timestamp_ntz")


def _with_day(orders):
    """Times as text, for comparison."""
    return orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


def _orders(spark, sf):
    return _with_day(table(spark, sf, "orders"))


def _round_trip(spark, sf, fmt, schema):
    path = fresh_path(spark, f"orders-{fmt}")
    write_table(table(spark, sf, "orders"), path, fmt)
    return read_table(spark, path, fmt, schema)


@query("scan_csv", ORDERS)
def scan_csv(spark, sf):
    return _with_day(_round_trip(spark, sf, "csv", ORDER_TYPES))


@query("scan_csv_inferred", f"""
WITH o AS ({ORDERS})
SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, o_orderstatus,
       o_totalprice, o_orderdate, o_orderpriority, 'timestamp' AS kind_of_date FROM o""")
def scan_csv_inferred(spark, sf):
    found = _round_trip(spark, sf, "csv", None)
    kind = dict(found.dtypes)["o_orderdate"].removesuffix("_ntz")
    return _with_day(found).withColumn("kind_of_date", F.lit(kind))


MARKS = """
SELECT doc_id, text, lang, source, n_chars,
       CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN ' a "q", ''b'' ' ELSE concat('x', chr(10), '\\', chr(9), '"') END AS mark
FROM documents"""


@query("scan_csv_documents", MARKS)
def scan_csv_documents(spark, sf):
    """Texts with quotes and line breaks, empty texts and NULL, written and read back."""
    rest = F.concat(F.lit("x\n\\\t"), F.lit('"'))
    kind = F.col("doc_id") % 4
    mark = F.when(kind == 1, "").when(kind == 2, " a \"q\", 'b' ").when(kind == 3, rest)
    documents = table(spark, sf, "documents").withColumn("mark", mark)
    path = fresh_path(spark, "documents-csv")
    write_table(documents, path, "csv")
    schema = "doc_id long, text string, lang string, source string, n_chars long, mark string"
    return read_table(spark, path, "csv", schema)


@query("scan_json", ORDERS)
def scan_json(spark, sf):
    return _with_day(_round_trip(spark, sf, "json", ORDER_TYPES))


@query("write_parquet", ORDERS)
def write_parquet(spark, sf):
    return _with_day(_round_trip(spark, sf, "parquet", None))


@query("schema_report", """
SELECT 0 AS position, 'o_orderkey' AS "column", 'bigint' AS dtype, 'numeric' AS kind,
       true AS nullable, count(o_orderkey) AS non_null_count FROM orders
UNION ALL SELECT 1, 'o_custkey', 'bigint', 'numeric', true, count(o_custkey) FROM orders
UNION ALL SELECT 2, 'o_orderstatus', 'string', 'categorical', true, count(o_orderstatus) FROM orders
UNION ALL SELECT 3, 'o_totalprice', 'double', 'numeric', true, count(o_totalprice) FROM orders
UNION ALL SELECT 4, 'o_orderdate', 'timestamp_ntz', 'temporal', true, count(o_orderdate) FROM orders
UNION ALL SELECT 5, 'o_orderpriority', 'string', 'categorical', true, count(o_orderpriority) FROM orders
""")
def schema_report(spark, sf):
    return profile.schema_report(table(spark, sf, "orders"))


@query("shape", "SELECT count(*) AS n_rows, 11::BIGINT AS n_columns FROM lineitem")
def shape(spark, sf):
    return profile.shape(table(spark, sf, "lineitem"))


@query("sample_rows", f"SELECT * FROM ({ORDERS}) ORDER BY o_orderkey LIMIT 5")
def sample_rows(spark, sf):
    return profile.sample_rows(_orders(spark, sf), 5, ["o_orderkey"])


LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
    "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


def _each(template: str, names) -> str:
    return "\nUNION ALL ".join(template.format(c=c) for c in names)


@query("numeric_summary", _each("""SELECT '{c}' AS "column", count({c}) AS count,
  round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS stddev,
  CAST(min({c}) AS DOUBLE) AS min, CAST(max({c}) AS DOUBLE) AS max FROM lineitem""", LINE_NUMBERS))
def numeric_summary(spark, sf):
    return rounded(profile.numeric_summary(table(spark, sf, "lineitem")), ["mean", "stddev"])


@query("numeric_quartiles", _each("""SELECT '{c}' AS "column",
  round(quantile_cont(CAST({c} AS DOUBLE), 0.25), 4) AS q25,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS q50,
  round(quantile_cont(CAST({c} AS DOUBLE), 0.75), 4) AS q75 FROM lineitem""", LINE_NUMBERS))
def numeric_quartiles(spark, sf):
    found = profile.numeric_summary(table(spark, sf, "lineitem"), quartiles=True)
    return rounded(found.select("column", "q25", "q50", "q75"), ["q25", "q50", "q75"])


@query("categorical_summary", "WITH " + GAPS + _each("""SELECT '{c}' AS "column", count({c}) AS count,
  min({c}) AS min, max({c}) AS max FROM gaps""", ["c_name", "c_mktsegment"]))
def categorical_summary(spark, sf):
    return profile.categorical_summary(gaps(spark, sf))


@query("categorical_top", "WITH " + GAPS + _each("""SELECT '{c}' AS "column", count({c}) AS count,
  count(DISTINCT {c}) AS unique,
  (SELECT {c} FROM gaps WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS top,
  (SELECT count(*) FROM gaps WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC LIMIT 1) AS freq
  FROM gaps""", ["c_name", "c_mktsegment"]))
def categorical_top(spark, sf):
    return profile.categorical_summary(gaps(spark, sf), top=True)


@query("full_profile", "WITH " + SALES + """
SELECT 'shape' AS section, 1::BIGINT AS n_rows
UNION ALL SELECT 'schema', 5
UNION ALL SELECT 'sample', least(count(*), 5) FROM sales
UNION ALL SELECT 'numeric_summary', 3
UNION ALL SELECT 'categorical_summary', 2
UNION ALL SELECT 'missing_counts', 5
UNION ALL SELECT 'missing_percentages', 5
UNION ALL SELECT 'duplicates', 1
UNION ALL SELECT 'frequencies', count(DISTINCT segment) + count(DISTINCT priority) FROM sales
UNION ALL SELECT 'histogram', 90
UNION ALL SELECT 'correlation', 9
UNION ALL SELECT 'kde', 200
UNION ALL SELECT 'value_counts', count(DISTINCT large) FROM sales
UNION ALL SELECT 'discrete_frequencies', count(DISTINCT large) FROM sales
UNION ALL SELECT 'counts_by_target:segment', count(DISTINCT (segment, large)) FROM sales
UNION ALL SELECT 'counts_by_target:priority', count(DISTINCT (priority, large)) FROM sales
UNION ALL SELECT 'mean_by_groups', count(DISTINCT (segment, priority)) FROM sales
UNION ALL SELECT 'box_stats:price', count(DISTINCT large) FROM sales
""")
def full_profile(spark, sf):
    tables = profiling.full(
        sales(spark, sf),
        target="large",
        discrete=["large"],
        continuous=["price"],
        by_target=["segment", "priority"],
        hue="priority",
        sample_order=["o_orderkey"],
    )
    parts = [
        found.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("section"), "n_rows")
        for name, found in tables.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole


#: Of each section the columns that name an item, and the numbers compared.
PROFILED = {
    "shape": ([], ["n_rows", "n_columns"]),
    "numeric_summary": (["column"], ["count", "mean", "stddev", "min", "max"]),
    "missing_counts": (["column"], ["null_count"]),
    "missing_percentages": (["column"], ["null_pct"]),
    "duplicates": ([], ["duplicate_count"]),
    "categorical_summary": (["column"], ["count"]),
    "frequencies": (["column", "value"], ["count", "share"]),
    "histogram": (["column", "bin"], ["lower", "upper", "count"]),
    "correlation": (["x", "y"], ["n", "corr"]),
    "value_counts": (["column", "value"], ["count"]),
    "discrete_frequencies": (["column", "value"], ["count", "share"]),
    "counts_by_target:segment": (["x", "target"], ["count", "share"]),
    "counts_by_target:priority": (["x", "target"], ["count", "share"]),
    "mean_by_groups": (["x", "hue"], ["count", "mean", "stddev"]),
    "box_stats:price": (["x"], ["count", "q1", "median", "q3", "n_outliers"]),
}
NUMBERS, TEXTS = ["o_orderkey", "price", "large"], ["segment", "priority"]


def _values_sql() -> str:
    parts = []

    def add(section: str, source: str) -> None:
        keys, values = PROFILED[section]
        item = " || ':' || ".join(f"CAST(\"{k}\" AS VARCHAR)" for k in keys) or "''"
        parts.extend(
            f"SELECT '{section}' AS section, {item} || ':{v}' AS item, round(CAST(\"{v}\" AS DOUBLE), 4) + 0.0 AS value FROM ({source})"
            for v in values
        )

    def each(template: str, names) -> str:
        return " UNION ALL ".join(template.format(c=c) for c in names)

    def shares(column: str, name: str) -> str:
        return (
            f"SELECT '{name}' AS \"column\", CAST({column} AS VARCHAR) AS value, count(*) AS count, "
            f"count(*) / CAST((SELECT count(*) FROM sales) AS DOUBLE) AS share FROM sales GROUP BY {column}"
        )

    add("shape", "SELECT count(*) AS n_rows, 5 AS n_columns FROM sales")
    add("numeric_summary", each("SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, "
        "stddev_samp({c}) AS stddev, min({c}) AS min, max({c}) AS max FROM sales", NUMBERS))
    nulls = "SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS null_count, " \
        "100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS null_pct FROM sales"
    add("missing_counts", each(nulls, [*NUMBERS, *TEXTS]))
    add("missing_percentages", each(nulls, [*NUMBERS, *TEXTS]))
    add("duplicates", "SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM sales)) AS duplicate_count FROM sales")
    add("categorical_summary", each("SELECT '{c}' AS \"column\", count({c}) AS count FROM sales", TEXTS))
    add("frequencies", " UNION ALL ".join(shares(c, c) for c in TEXTS))
    bins = (
        "SELECT '{c}' AS \"column\", b AS bin, lo + b * w AS lower, lo + (b + 1) * w AS upper, count(v) AS count FROM "
        "(SELECT min({c})::DOUBLE AS lo, (max({c}) - min({c}))::DOUBLE / 30 AS w FROM sales) CROSS JOIN range(30) r(b) "
        "LEFT JOIN (SELECT {c}::DOUBLE AS v FROM sales) ON least(floor((v - lo) / w), 29) = b GROUP BY b, lo, w"
    )
    add("histogram", each(bins, NUMBERS))
    add("correlation", " UNION ALL ".join(
        f"SELECT '{a}' AS x, '{b}' AS y, count(*) AS n, corr({a}, {b}) AS corr FROM sales" for a in NUMBERS for b in NUMBERS))
    add("value_counts", shares("large", "large"))
    add("discrete_frequencies", shares("large", "large"))
    for name in TEXTS:
        add(f"counts_by_target:{name}", f"SELECT {name} AS x, large AS target, count(*) AS count, "
            f"count(*) / CAST(sum(count(*)) OVER (PARTITION BY {name}) AS DOUBLE) AS share FROM sales GROUP BY {name}, large")
    add("mean_by_groups", "SELECT segment AS x, priority AS hue, count(*) AS count, avg(large) AS mean, "
        "stddev_samp(large) AS stddev FROM sales GROUP BY segment, priority")
    quartiles = "SELECT large, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.5) AS median, " \
        "quantile_cont(price, 0.75) AS q3 FROM sales GROUP BY large"
    add("box_stats:price", f"SELECT large AS x, count(*) AS count, q1, median, q3, count(*) FILTER "
        f"(price < q1 - 1.5 * (q3 - q1) OR price > q3 + 1.5 * (q3 - q1)) AS n_outliers "
        f"FROM sales JOIN ({quartiles}) USING (large) GROUP BY large, q1, median, q3")
    return "WITH " + SALES + "\n" + "\nUNION ALL ".join(parts)


@query("full_profile_values", _values_sql())
def full_profile_values(spark, sf):
    """The values of the full profile in long form, one row per section, item and number."""
    tables = profiling.full(
        sales(spark, sf),
        target="large",
        discrete=["large"],
        continuous=["price"],
        by_target=TEXTS,
        hue="priority",
        sample_order=["o_orderkey"],
    )
    parts = []
    for section, (keys, values) in PROFILED.items():
        found = tables[section]
        item = F.concat_ws(":", *[F.col(f"`{k}`").cast("string") for k in keys])
        numbers = F.explode(
            F.array(*[F.struct(F.lit(v).alias("name"), F.col(f"`{v}`").cast("double").alias("value")) for v in values])
        )
        long = found.select(item.alias("item"), numbers.alias("v"))
        parts.append(
            long.select(
                F.lit(section).alias("section"),
                F.concat(F.col("item"), F.lit(":"), F.col("v.name")).alias("item"),
                (F.round("v.value", 4) + F.lit(0.0)).alias("value"),
            )
        )
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionAll(part)
    return whole
