"""Encoding, feature vectors, scaling and splitting."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from registry import query
from registry.fixtures import GAPS, LINES, gaps, lines, rounded, table
from tablecraft.operators import encode, features, scale, split


def _elements(df, vector: str, names):
    parts = vector_to_array(F.col(vector))
    return df.withColumns({n: parts[i] for i, n in enumerate(names)}).drop(vector)


@query("label_encode", "WITH " + GAPS + """
SELECT c_custkey, c_name, c_acctbal,
       CASE WHEN c_nationkey IS NULL THEN (SELECT count(DISTINCT c_nationkey) FROM gaps)::DOUBLE
            ELSE (dense_rank() OVER (ORDER BY c_nationkey NULLS LAST) - 1)::DOUBLE END AS c_nationkey,
       CASE WHEN c_mktsegment IS NULL THEN (SELECT count(DISTINCT c_mktsegment) FROM gaps)::DOUBLE
            ELSE (dense_rank() OVER (ORDER BY c_mktsegment NULLS LAST) - 1)::DOUBLE END AS c_mktsegment
FROM gaps""")
def label_encode(spark, sf):
    return encode.label_encode(gaps(spark, sf), ["c_mktsegment", "c_nationkey"])


@query("label_encode_many_values", """
SELECT o_orderkey, (dense_rank() OVER (ORDER BY o_totalprice) - 1)::DOUBLE AS o_totalprice FROM orders""")
def label_encode_many_values(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return encode.label_encode(orders, ["o_totalprice"], max_labels=1_000)


@query("label_encode_many_texts", """
SELECT doc_id, (dense_rank() OVER (ORDER BY text) - 1)::DOUBLE AS text FROM documents""")
def label_encode_many_texts(spark, sf):
    documents = table(spark, sf, "documents").select("doc_id", "text")
    return encode.label_encode(documents, ["text"], max_labels=100)


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _marks(values) -> str:
    return ", ".join(
        f"CAST(coalesce(c_mktsegment = '{v}', false) AS INTEGER) AS \"c_mktsegment_{v}\"" for v in values
    )


@query("onehot", "WITH " + GAPS + f"""
SELECT *, {_marks(SEGMENTS[:-1])}, CAST(c_mktsegment IS NULL AS INTEGER) AS c_mktsegment_unknown
FROM gaps""")
def onehot(spark, sf):
    return encode.onehot(gaps(spark, sf), ["c_mktsegment"], unknown=True)


@query("onehot_vector", "WITH " + GAPS + f"SELECT c_custkey, {_marks(SEGMENTS)} FROM gaps")
def onehot_vector(spark, sf):
    coded = encode.onehot_vector(gaps(spark, sf), ["c_mktsegment"], drop_last=False)
    names = [f"c_mktsegment_{v}" for v in SEGMENTS]
    plain = _elements(coded.select("c_custkey", "c_mktsegment_ohe"), "c_mktsegment_ohe", names)
    return plain.withColumns({n: F.col(n).cast("int") for n in names})


@query("assemble_features", "WITH " + GAPS + """
SELECT c_custkey, CAST(c_acctbal AS DOUBLE) AS balance, CAST(c_nationkey AS DOUBLE) AS nation
FROM gaps WHERE c_acctbal IS NOT NULL AND c_nationkey IS NOT NULL""")
def assemble_features(spark, sf):
    made = features.assemble(gaps(spark, sf), ["c_acctbal", "c_nationkey"])
    return _elements(made.select("c_custkey", "features"), "features", ["balance", "nation"])


LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE_CATEGORIES = ["l_returnflag", "l_linestatus"]


@query("build_features", "WITH " + LINES + """
SELECT l_orderkey, l_linenumber, label, l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2,
       l_tax AS f3, CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS f4,
       CAST(dense_rank() OVER (ORDER BY l_linestatus) - 1 AS DOUBLE) AS f5
FROM lines""")
def build_features(spark, sf):
    made, _ = features.build(lines(spark, sf), LINE_FEATURES, LINE_CATEGORIES)
    kept = made.select("l_orderkey", "l_linenumber", "label", "features")
    return _elements(kept, "features", [f"f{i}" for i in range(6)])


def _flags(column: str, values) -> str:
    return ", ".join(
        f"CAST({column} = '{v}' AS DOUBLE) AS {column}_{v}" for v in values
    )


FLAGS = {"l_returnflag": ["A", "N", "R"], "l_linestatus": ["F", "O"]}


@query("staged_features", "WITH " + LINES + f"""
SELECT l_orderkey, l_linenumber, l_quantity AS f0, l_tax AS f1,
       {", ".join(_flags(c, v) for c, v in FLAGS.items())}
FROM lines""")
def staged_features(spark, sf):
    rows = lines(spark, sf)
    staged = features.pipeline(rows, ["l_quantity", "l_tax"], list(FLAGS), encoding="onehot")
    made = staged.fit(rows).transform(rows).select("l_orderkey", "l_linenumber", "features")
    names = ["f0", "f1", *[f"{c}_{v}" for c, values in FLAGS.items() for v in values]]
    return _elements(made, "features", names)


@query("build_features_scaled", "WITH " + LINES + """,
coded AS (
  SELECT l_orderkey, l_linenumber, label, l_quantity, l_discount,
         CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS DOUBLE) AS flag
  FROM lines)
SELECT l_orderkey, l_linenumber, label,
       round((l_quantity - avg(l_quantity) OVER ()) / stddev_samp(l_quantity) OVER (), 4) + 0.0 AS f0,
       round((l_discount - avg(l_discount) OVER ()) / stddev_samp(l_discount) OVER (), 4) + 0.0 AS f1,
       round((flag - avg(flag) OVER ()) / stddev_samp(flag) OVER (), 4) + 0.0 AS f2
FROM coded""")
def build_features_scaled(spark, sf):
    made, _ = features.build(lines(spark, sf), ["l_quantity", "l_discount"], ["l_returnflag"], scale=True)
    kept = made.select("l_orderkey", "l_linenumber", "label", "features")
    return rounded(_elements(kept, "features", ["f0", "f1", "f2"]), ["f0", "f1", "f2"])


def _slot(text: str, width: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({text} AS VARCHAR)), 1, 12) AS BIGINT) % {width}"


@query("build_features_hashed", "WITH " + LINES + f"""
SELECT l_orderkey, l_linenumber, label, l_quantity AS f0,
       CAST({_slot("l_orderkey", 1000)} AS DOUBLE) AS f1, CAST({_slot("l_returnflag", 1000)} AS DOUBLE) AS f2
FROM lines""")
def build_features_hashed(spark, sf):
    """A category per order: 150 000 of them at sf0.1, more than are ever listed."""
    made, _ = features.build(lines(spark, sf), ["l_quantity"], ["l_orderkey", "l_returnflag"], hash_width=1000)
    kept = made.select("l_orderkey", "l_linenumber", "label", "features")
    return _elements(kept, "features", ["f0", "f1", "f2"])


@query("onehot_hashed", "WITH " + GAPS + "SELECT c_custkey, " + ", ".join(
    f"CAST(coalesce({_slot('c_mktsegment', 6)} = {k}, false) AS INTEGER) AS slot_{k}" for k in range(6)) + " FROM gaps")
def onehot_hashed(spark, sf):
    coded = encode.onehot_vector(gaps(spark, sf), ["c_mktsegment"], hash_width=6)
    names = [f"slot_{k}" for k in range(6)]
    plain = _elements(coded.select("c_custkey", "c_mktsegment_ohe"), "c_mktsegment_ohe", names)
    return plain.withColumns({n: F.col(n).cast("int") for n in names})


@query("hash_report", "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(sum(n) AS BIGINT) AS categories, count(*) AS slots_used,
       CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS sharing, max(n) AS largest_slot
FROM (SELECT {_slot(c, 5000)} AS slot, count(DISTINCT {c}) AS n FROM lineitem GROUP BY ALL)"""
    for c in ("l_orderkey", "l_partkey", "l_returnflag")))
def hash_report(spark, sf):
    return encode.hash_report(table(spark, sf, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag"], 5000)


Z = "round(({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER (), 4) + 0.0 AS {c}_standard"
M = "round(({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()), 4) + 0.0 AS {c}_minmax"


def _scaled(template: str) -> str:
    columns = ", ".join(template.format(c=c) for c in LINE_FEATURES)
    return f"SELECT l_orderkey, l_linenumber, {columns} FROM lineitem"


def _plain(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *LINE_FEATURES)


@query("standard_scale", _scaled(Z))
def standard_scale(spark, sf):
    made = scale.standard(_plain(spark, sf), LINE_FEATURES, as_columns=True).drop(*LINE_FEATURES)
    return rounded(made, [f"{c}_standard" for c in LINE_FEATURES])


@query("standard_scale_vector", _scaled(Z))
def standard_scale_vector(spark, sf):
    made = scale.standard(_plain(spark, sf), LINE_FEATURES).drop(*LINE_FEATURES)
    names = [f"{c}_standard" for c in LINE_FEATURES]
    return rounded(_elements(made, scale.STANDARD_OUTPUT, names), names)


@query("minmax_scale", _scaled(M))
def minmax_scale(spark, sf):
    made = scale.minmax(_plain(spark, sf), LINE_FEATURES, as_columns=True).drop(*LINE_FEATURES)
    return rounded(made, [f"{c}_minmax" for c in LINE_FEATURES])


@query("minmax_scale_vector", _scaled(M))
def minmax_scale_vector(spark, sf):
    made = scale.minmax(_plain(spark, sf), LINE_FEATURES).drop(*LINE_FEATURES)
    names = [f"{c}_minmax" for c in LINE_FEATURES]
    return rounded(_elements(made, scale.MINMAX_OUTPUT, names), names)


@query("hash_split", """
SELECT o_orderkey,
       CASE WHEN CAST('0x' || substr(md5(concat_ws(':', o_orderkey, '42')), 1, 8) AS BIGINT)
                 / 4294967296.0::DOUBLE < 0.8 THEN 'train' ELSE 'test' END AS split
FROM orders""")
def hash_split(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey")
    return split.with_split(orders, "o_orderkey")


@query("random_split")
def random_split(spark, sf):
    train, test = split.random_split(table(spark, sf, "orders").select("o_orderkey"))
    return train.withColumn("split", F.lit("train")).unionAll(test.withColumn("split", F.lit("test")))


FITTED_ON_TRAIN = "WITH " + LINES + """, sided AS (
  SELECT *, CAST('0x' || substr(md5(concat_ws(':', l_orderkey, l_linenumber, '42')), 1, 8) AS BIGINT)
            / 4294967296.0::DOUBLE < 0.8 AS is_train FROM lines),
fitted AS (SELECT avg(l_quantity) AS m, stddev_samp(l_quantity) AS s, min(l_tax) AS lo, max(l_tax) AS hi
           FROM sided WHERE is_train)
SELECT l_orderkey, l_linenumber, round((l_quantity - m) / s, 4) + 0.0 AS l_quantity_standard,
       round((l_tax - lo) / (hi - lo), 4) + 0.0 AS l_tax_minmax
FROM sided, fitted WHERE NOT is_train"""


@query("scale_test_rows_by_training_rows", FITTED_ON_TRAIN)
def scale_test_rows_by_training_rows(spark, sf):
    train, test = split.hash_split(lines(spark, sf), ["l_orderkey", "l_linenumber"])
    scaled = scale.fit_standard(train, ["l_quantity"]).columns(test)
    scaled = scale.fit_minmax(train, ["l_tax"]).columns(scaled)
    kept = scaled.select("l_orderkey", "l_linenumber", "l_quantity_standard", "l_tax_minmax")
    return rounded(kept, ["l_quantity_standard", "l_tax_minmax"])
