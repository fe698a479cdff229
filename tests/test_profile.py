import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablecraft.functions.columns import categorical_columns, numeric_columns, require_columns
from tablecraft.operators import distributions, duplicates, missing, profile, relations
from tablecraft.plans import profiling
from tablecraft.sources.tables import read_table, write_table

NAN = float("nan")


def rows(df):
    return [tuple(r) for r in df.collect()]


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(3)
    data = pd.DataFrame(
        {
            "a": rng.normal(size=5000).round(3),
            "b": rng.exponential(size=5000).round(2),
            "c": rng.integers(0, 5, 5000),
            "g": rng.choice(["hot", "hot", "hot", "x", "y"], 5000),
        }
    )
    data.loc[::17, "a"] = np.nan
    return data, spark.createDataFrame(data)


def test_every_numeric_type_counts_as_numeric(spark):
    df = spark.createDataFrame(
        [], "a byte, b short, c int, d long, e float, f double, g decimal(9,2), h string, i boolean, j date"
    )
    assert numeric_columns(df) == list("abcdefg")
    assert categorical_columns(df) == ["h"]
    assert require_columns(df, ["a", "h", "z"], strict=False, kinds=["numeric"]) == (["a"], ["h", "z"])
    kinds = {c: r["kind"] for c, r in by_column(profile.schema_report(df)).items()}
    assert kinds["g"] == "numeric" and kinds["i"] == "boolean" and kinds["j"] == "temporal"


def test_summary_matches_pandas(numbers):
    data, df = numbers
    want = data.describe()
    got = by_column(profile.numeric_summary(df, quartiles=True))
    for name in ("a", "b", "c"):
        for ours, theirs in [("count", "count"), ("mean", "mean"), ("stddev", "std"), ("min", "min"),
                             ("max", "max"), ("q25", "25%"), ("q50", "50%"), ("q75", "75%")]:
            assert got[name][ours] == pytest.approx(want.loc[theirs, name]), (name, ours)
    rough = by_column(profile.numeric_summary(df, quartiles=True, exact=False))
    assert rough["a"]["q50"] == pytest.approx(want.loc["50%", "a"], abs=0.05)


def test_summary_of_edge_columns(spark):
    df = spark.createDataFrame([(None, NAN, Decimal("2.5"))], "e double, n double, d decimal(5,2)")
    got = by_column(profile.numeric_summary(df, quartiles=True))
    assert got["e"]["count"] == 0 and got["n"]["count"] == 0 and got["n"]["mean"] is None
    assert got["d"]["q50"] == 2.5 and got["d"]["stddev"] is None
    texts = spark.createDataFrame([("a",)], "s string")
    assert profile.numeric_summary(texts, quartiles=True).collect() == []
    assert profile.categorical_summary(df, top=True).collect() == []


def test_top_of_an_all_null_column(spark):
    df = spark.createDataFrame([(None, "b"), (None, "a")], "e string, s string")
    got = by_column(profile.categorical_summary(df, top=True))
    assert got["e"] == {"column": "e", "count": 0, "unique": 0, "top": None, "freq": None}
    assert got["s"] == {"column": "s", "count": 2, "unique": 2, "top": "a", "freq": 1}


def test_duplicates_equate_null_nan_and_signed_zero(spark):
    df = spark.createDataFrame(
        [(0.0, None), (-0.0, None), (NAN, "x"), (NAN, "x"), (1.0, "y")], "d double, s string"
    )
    assert rows(duplicates.count(df)) == [(2,)]
    assert duplicates.drop(df).count() == 3
    assert duplicates.drop(duplicates.drop(df)).count() == 3
    assert rows(duplicates.drop_report(df)) == [(5, 3, 2)]
    told = duplicates.report(df.limit(0)).first()
    assert (told.total_rows, told.duplicate_pct, told.has_duplicates) == (0, 0.0, False)


@pytest.mark.parametrize("held", [True, False])
def test_many_repeats_are_found_both_ways(spark, monkeypatch, held):
    if not held:
        monkeypatch.setattr(duplicates, "HELD_HASHES", 3)
    df = spark.range(3_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id") % 700).alias("k"),
        F.lit("same").alias("s"),
        "id",
    )
    # 1000 rows share the NULL key; the other 2000 have 700 distinct keys.
    assert rows(duplicates.count(df, ["k", "s"])) == [(3_000 - 701,)]
    assert rows(duplicates.count(df)) == [(0,)]
    kept = duplicates.drop(df, ["k", "s"], keep_by=["id"])
    data = df.toPandas().sort_values("id").drop_duplicates(["k", "s"])
    assert sorted(r.id for r in kept.collect()) == sorted(data["id"])
    assert duplicates.drop(df, ["k"]).count() == 701


def test_survivor_is_chosen_by_order(spark):
    df = spark.createDataFrame([(2, "k", "b"), (1, "k", "c"), (3, "m", "d")], "id int, k string, v string")
    assert sorted(rows(duplicates.drop(df, ["k"], keep_by=["id"]))) == [(1, "k", "c"), (3, "m", "d")]
    assert sorted(rows(duplicates.drop(df, ["k"], ["id"], keep_last=True))) == [(2, "k", "b"), (3, "m", "d")]
    assert duplicates.drop(df, ["k"], keep_by=["id"]).columns == df.columns


def test_value_counts_orders(spark):
    df = spark.createDataFrame([(10, "b"), (9, "a"), (None, "a"), (9, None)], "n int, s string")
    assert rows(distributions.value_counts(df, ["n"])) == [("n", None, 1), ("n", "9", 2), ("n", "10", 1)]
    assert rows(distributions.value_counts(df, ["n", "s"], dropna=True, order="count")) == [
        ("n", "9", 2), ("n", "10", 1), ("s", "a", 2), ("s", "b", 1)
    ]
    shares = rows(distributions.frequencies(df))
    assert sorted(shares) == [("s", "a", 2, pytest.approx(2 / 3)), ("s", "b", 1, pytest.approx(1 / 3))]


def test_histogram_matches_numpy(numbers):
    data, df = numbers
    for name in ("a", "b", "c"):
        values = data[name].dropna()
        got = sorted((r.bin, r["count"]) for r in distributions.histogram(df, [name]).collect())
        want, _ = np.histogram(values, bins=30)
        assert sum(n for _, n in got) == len(values)
        # A value on an inner border may fall on either side by rounding.
        assert np.abs(np.cumsum([n for _, n in got]) - np.cumsum(want)).max() <= (values.value_counts().max())


def test_histogram_of_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(2.0, None), (2.0, None)], "k double, e double")
    got = distributions.histogram(df, bins=4).collect()
    assert {r["column"] for r in got} == {"k"}
    assert (min(r.lower for r in got), max(r.upper for r in got)) == (1.5, 2.5)
    assert sum(r["count"] for r in got) == 2
    assert distributions.histogram(df.limit(0)).collect() == []


def test_density_is_exact(numbers):
    data, df = numbers
    values = data["b"].to_numpy()
    width = values.std(ddof=1) * len(values) ** -0.2
    grid = np.linspace(values.min(), values.max(), 200)
    want = np.exp(-0.5 * ((grid[:, None] - values) / width) ** 2).sum(axis=1) / (
        len(values) * width * math.sqrt(2 * math.pi)
    )
    got = sorted((r.x, r.density) for r in distributions.kde(df, ["b"]).collect())
    assert [x for x, _ in got] == pytest.approx(list(grid))
    assert [d for _, d in got] == pytest.approx(list(want), rel=1e-9, abs=1e-14)
    constant = df.select(F.lit(1.0).alias("k"))
    assert distributions.kde(constant).collect() == []


def test_box_numbers_match_pandas_and_hot_groups_agree_with_the_shuffled_way(numbers, monkeypatch):
    data, df = numbers
    got = {r.x: r for r in relations.box_stats(df, "g", "b").collect()}
    for name, values in data.groupby("g")["b"]:
        q1, median, q3 = values.quantile([0.25, 0.5, 0.75])
        inside = values[(values >= q1 - 1.5 * (q3 - q1)) & (values <= q3 + 1.5 * (q3 - q1))]
        row = got[name]
        assert (row.q1, row.median, row.q3) == pytest.approx((q1, median, q3))
        assert (row.whisker_low, row.whisker_high) == (inside.min(), inside.max())
        assert row.n_outliers == len(values) - len(inside) and row["count"] == len(values)
    found = relations.outliers(df, "g", "b")
    assert found.count() == sum(r.n_outliers for r in got.values())

    import tablecraft.functions.ordered as ordered

    monkeypatch.setattr(ordered, "hold", lambda table: None)
    monkeypatch.setattr(relations, "hold", lambda table: None)
    assert {r.x: r for r in relations.box_stats(df, "g", "b").collect()} == got
    shuffled = relations.outliers(df, "g", "b")
    assert sorted(rows(found.select("b", "c", "g"))) == sorted(rows(shuffled.select("b", "c", "g")))


def test_correlation_matches_pandas_and_guards_constants(numbers):
    data, df = numbers
    frame = df.withColumn("k", F.lit(7))
    got = {(r.x, r.y): r["corr"] for r in relations.correlation_matrix(frame).collect()}
    want = data[["a", "b", "c"]].corr()
    assert len(got) == 16
    for x in "abc":
        for y in "abc":
            assert got[x, y] == pytest.approx(want.loc[x, y])
        assert got[x, "k"] is None
    assert got["k", "k"] is None


def test_correlation_of_many_columns_matches_pandas(spark):
    rng = np.random.default_rng(5)
    data = pd.DataFrame(rng.normal(size=(2_000, 13)), columns=[f"c{i}" for i in range(13)])
    data["c1"] = data["c0"] * 2 + data["c1"] + 1e6
    data["c2"] = 1e9 + data["c2"]
    data["c3"] = 4.0
    for i in range(13):
        data.loc[rng.random(2_000) < 0.1 * (i % 4), f"c{i}"] = np.nan
    data["c12"] = np.nan
    # Varies as a whole, but not where c11 is present.
    data["c10"] = np.where(data["c11"].notna(), 1.0, data["c10"])
    got = {(r.x, r.y): r for r in relations.correlation_matrix(spark.createDataFrame(data)).collect()}
    want = data.corr()
    assert len(got) == 169
    for (x, y), row in got.items():
        assert row.n == int((data[x].notna() & data[y].notna()).sum())
        if np.isnan(want.loc[x, y]):
            assert row["corr"] is None, (x, y)
        else:
            assert row["corr"] == pytest.approx(want.loc[x, y], abs=1e-6), (x, y)


def test_grouped_means_and_two_way_counts(spark):
    df = spark.createDataFrame(
        [("a", "u", 1.0), ("a", "u", 3.0), ("a", "v", 5.0), ("b", "u", None), (None, "u", 2.0)],
        "x string, h string, y double",
    )
    got = {(r.x, r.hue): r for r in relations.mean_by_groups(df, "x", "y", "h").collect()}
    assert set(got) == {("a", "u"), ("a", "v")}
    assert got["a", "u"].mean == 2.0 and got["a", "v"].stddev is None and got["a", "v"].ci_low is None
    assert got["a", "u"].ci_high == pytest.approx(2 + 1.96 * math.sqrt(2) / math.sqrt(2))
    counted = sorted(rows(relations.counts_by_target(df, "x", "h")))
    assert counted == [("a", "u", 2, pytest.approx(2 / 3)), ("a", "v", 1, pytest.approx(1 / 3)),
                       ("b", "u", 1, 1.0)]
    assert relations.counts_by_target(df, "x", "h", dropna=False).count() == 4


def test_profile_leaves_out_what_the_table_lacks(numbers):
    _, df = numbers
    tables = profiling.full(df.select("a", "b"), target="label", discrete=["c"], continuous=["b", "zz"])
    assert "frequencies" not in tables and "value_counts" not in tables
    assert "box_stats:b" not in tables and "kde" in tables


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_tables_survive_a_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, "a,b", 1.5), (2, None, None)], "i long, s string, d double")
    write_table(df, str(tmp_path / fmt), fmt)
    back = read_table(spark, str(tmp_path / fmt), fmt, df.schema)
    assert sorted(rows(back)) == sorted(rows(df))
    with pytest.raises(Exception, match="(?i)exists"):
        write_table(df, str(tmp_path / fmt), fmt)
    with pytest.raises(ValueError, match="format"):
        read_table(spark, str(tmp_path), "xml")


def test_density_from_cells_is_that_of_all_values(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=3000), rng.exponential(size=500) * 30, [250.0]])
    df = spark.createDataFrame([(float(v), float(v) * 1e6 + 1e9) for v in values], "a double, b double").repartition(4)
    near = {(r.column, round(r.x, 6)): r.density for r in distributions.kde(df).collect()}
    far = {(r.column, round(r.x, 6)): r.density for r in distributions.kde(df, exact=True).collect()}
    assert set(near) == set(far) and len(near) == 400
    for at, density in far.items():
        assert near[at] == pytest.approx(density, abs=1e-9 if at[0] == "a" else 1e-15), at


def test_bootstrap_interval_is_the_same_on_every_layout(spark):
    rng = np.random.default_rng(6)
    rows = [(k, "a" if k % 3 else None if k % 2 else "b", float(v)) for k, v in enumerate(rng.normal(10, 2, 4000))]
    df = spark.createDataFrame([*rows, (5000, "one", 3.0), (5001, "a", None)], "k int, x string, y double")
    found = [
        {r.x: r for r in relations.bootstrap_mean_by_groups(frame, "x", "y", "k", replicates=100).collect()}
        for frame in (df.repartition(3), df.repartition(7, "y"))
    ]
    assert set(found[0]) == {"a", "b", "one"}
    for x, r in found[0].items():
        again = found[1][x]
        assert (r.ci_low, r.ci_high) == (pytest.approx(again.ci_low), pytest.approx(again.ci_high))
    data = {x: np.array([v for _, y, v in rows if y == x]) for x in ("a", "b")}
    for x, values in data.items():
        r, error = found[0][x], values.std(ddof=1) / np.sqrt(len(values))
        assert r["count"] == len(values) and r.mean == pytest.approx(values.mean())
        assert r.ci_high - r.ci_low == pytest.approx(3.92 * error, rel=0.3)
        assert r.ci_low < r.mean < r.ci_high
    assert (found[0]["one"].ci_low, found[0]["one"].ci_high) == (3.0, 3.0)
    with_null = relations.bootstrap_mean_by_groups(df, "x", "y", "k", replicates=5, dropna=False)
    assert {r.x for r in with_null.collect()} == {"a", "b", None, "one"}


def test_overview_equals_the_single_tables(spark):
    df = spark.createDataFrame(
        [(1, 2.5, "b", None, True), (None, NAN, None, None, None), (3, float("inf"), "a", None, False), (3, -1.0, "", None, True)],
        "i long, `d.x` double, s string, empty decimal(9,2), flag boolean",
    )
    for frame in (df, df.limit(0)):
        for block in (200, 2):
            seen = profile.overview(frame, block)
            single = {
                "shape": profile.shape(frame),
                "schema": profile.schema_report(frame),
                "numeric_summary": profile.numeric_summary(frame),
                "categorical_summary": profile.categorical_summary(frame),
                "missing_counts": missing.counts(frame),
                "missing_percentages": missing.percentages(frame),
            }
            for name, table in single.items():
                got = seen.tables[name]
                assert got.columns == table.columns and got.dtypes == table.dtypes, name
                assert sorted(map(str, rows(got))) == sorted(map(str, rows(table))), name
            assert sorted(map(str, rows(distributions.histogram(frame, spans=seen.spans)))) == sorted(
                map(str, rows(distributions.histogram(frame)))
            )


@pytest.mark.parametrize("held", [True, False])
def test_box_numbers_of_many_groups_match_pandas(spark, monkeypatch, held):
    """Heavy tails, constant groups, groups of one row, a hot group, a frequent value."""
    import tablecraft.functions.ordered as ordered

    if not held:
        monkeypatch.setattr(ordered.hold, "__defaults__", (20,))
    rng = np.random.default_rng(8)
    groups = np.concatenate([rng.integers(0, 400, 6000), np.full(3000, 1000), np.arange(2000, 2050)])
    values = np.round(rng.standard_t(2, len(groups)) * 10, 3)
    values[rng.random(len(groups)) < 0.3] = 2.5
    values[groups < 20] = 4.0
    data = pd.DataFrame({"x": groups, "y": values})
    df = spark.createDataFrame(data).repartition(4)
    got = {r.x: r for r in relations.box_stats(df, "x", "y").collect()}
    assert set(got) == set(data.x)
    for key, part in data.groupby("x")["y"]:
        q1, median, q3 = part.quantile([0.25, 0.5, 0.75])
        row = got[key]
        assert (row["count"], row.q1, row.median, row.q3) == pytest.approx((len(part), q1, median, q3))
        inside = part[(part >= row.q1 - 1.5 * (row.q3 - row.q1)) & (part <= row.q3 + 1.5 * (row.q3 - row.q1))]
        assert (row.whisker_low, row.whisker_high) == (inside.min(), inside.max())
        assert row.n_outliers == len(part) - len(inside)
