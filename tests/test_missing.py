import datetime
import random
from decimal import Decimal

import pytest

from tablecraft.operators import missing

NAN = float("nan")


def rows(df):
    return [tuple(r) for r in df.collect()]


def by_column(df):
    return {r["column"]: r.asDict() for r in df.collect()}


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [(1, 1.0, "a", None), (2, NAN, None, None), (3, None, "b", None), (None, 4.0, "b", None)],
        "i int, d double, s string, empty double",
    )


def test_nulls_and_nans_are_told_apart(mixed):
    told = by_column(missing.report(mixed))
    assert told["d"]["null_count"] == 1 and told["d"]["nan_count"] == 1
    assert told["i"] == {
        "column": "i", "total_rows": 4, "null_count": 1, "nan_count": 0,
        "null_pct": 25.0, "has_missing": True,
    }
    assert told["empty"]["null_pct"] == 100.0
    assert {r[0]: r[1] for r in rows(missing.counts(mixed))} == {"i": 1, "d": 1, "s": 1, "empty": 4}


def test_empty_table_is_zero_percent(mixed):
    nothing = mixed.limit(0)
    assert {r["null_pct"] for r in missing.report(nothing).collect()} == {0.0}
    assert {r["null_pct"] for r in missing.percentages(nothing).collect()} == {0.0}
    assert rows(missing.drop_rows_report(nothing)) == [(0, 0, 0)]


def test_report_over_many_columns_uses_several_passes(spark):
    from pyspark.sql import functions as F

    wide = spark.range(3).select(
        *[F.when(F.col("id") > i % 3, F.col("id")).alias(f"c{i}") for i in range(250)]
    )
    told = by_column(missing.report(wide))
    assert len(told) == 250
    assert [told[f"c{i}"]["null_count"] for i in (0, 1, 2)] == [1, 2, 3]


def test_mean_ignores_nan_and_fills_it(mixed):
    filled, told = missing.fill_mean(mixed, ["d"])
    assert [r.d for r in filled.collect()] == [1.0, 2.5, 2.5, 4.0]
    assert rows(told) == [("fill_mean", "d", "filled", "2.5")]


@pytest.mark.parametrize("values, expected", [([2, 3, 3], 2), ([-2, -3, -3], -2)])
def test_mean_of_integers_is_truncated_unless_widened(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in [*values, None]], "i int")
    assert [r.i for r in missing.fill_mean(df, ["i"]).table.collect()][-1] == expected
    wide = missing.fill_mean(df, ["i"], widen=True).table
    assert dict(wide.dtypes)["i"] == "double"
    assert [r.i for r in wide.collect()][-1] == pytest.approx(sum(values) / 3)


def test_column_without_values_is_skipped(mixed):
    for fill in (missing.fill_mean, missing.fill_mode):
        filled, told = fill(mixed, ["empty"])
        assert [r.empty for r in filled.collect()] == [None] * 4
        assert rows(told)[0][2] == "no_data"
    for error in (0, 0.01):
        filled, told = missing.fill_median(mixed, ["empty"], relative_error=error)
        assert [r.empty for r in filled.collect()] == [None] * 4
        assert rows(told)[0][2] == "no_data"


def test_exact_median_is_a_value_and_keeps_big_longs(spark):
    big = 9007199254740993
    df = spark.createDataFrame(
        [(big, Decimal("1.25"), 3), (big + 2, Decimal("1.50"), 7), (big - 2, Decimal("9.75"), None),
         (None, None, 5)],
        "l long, d decimal(10,2), i int",
    )
    filled = missing.fill_median(df, ["l", "d", "i"], relative_error=0).table.collect()
    assert filled[3].l == big
    assert filled[3].d == Decimal("1.50")
    assert filled[2].i == 5


def test_median_of_even_count_is_the_lower_one(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)] + [(None,)], "d double")
    assert missing.fill_median(df, ["d"], relative_error=0).table.collect()[4].d == 2.0


def test_mode_ties_take_the_lowest_and_keep_type(spark):
    big = 9007199254740993
    day = datetime.date(2024, 1, 2)
    df = spark.createDataFrame(
        [("b", big, True, day), ("a", big, True, day), ("b", 1, False, None), ("a", None, None, None),
         (None, None, None, None)],
        "s string, l long, b boolean, t date",
    )
    filled = missing.fill_mode(df, ["s", "l", "b", "t"]).table.collect()
    assert tuple(filled[4]) == ("a", big, True, day)


def test_strict_and_lenient_columns(mixed):
    with pytest.raises(ValueError, match="nope"):
        missing.fill_mean(mixed, ["d", "nope"])
    filled, told = missing.fill_mean(mixed, ["s", "nope"], strict=False)
    assert rows(filled.select("s")) == rows(mixed.select("s"))
    assert {(r["column"], r["status"]) for r in told.collect()} == {("s", "ignored"), ("nope", "ignored")}


def test_fill_values_and_drop_rows(mixed):
    filled = missing.fill_values(mixed, {"i": 9, "d": 0, "s": "x"}).table.drop("empty")
    assert rows(filled) == [(1, 1.0, "a"), (2, 0.0, "x"), (3, 0.0, "b"), (9, 4.0, "b")]
    assert rows(missing.drop_rows(mixed, ["d"]).select("i")) == [(1,), (None,)]
    assert missing.drop_rows(mixed).count() == 0
    assert rows(missing.drop_rows_report(mixed, ["d"])) == [(4, 2, 2)]


def test_columns_with_dots_and_backticks(spark):
    df = spark.createDataFrame([(1.0, "x"), (None, None), (3.0, "x")], "`a.b` double, `c``d` string")
    filled = missing.fill_mean(df, ["a.b"]).table
    filled = missing.fill_mode(filled, ["c`d"]).table
    assert rows(filled) == [(1.0, "x"), (2.0, "x"), (3.0, "x")]
    assert by_column(missing.report(df))["a.b"]["null_count"] == 1


def test_default_median_keeps_large_longs_and_decimals(spark):
    big, exact = 9007199254740993, Decimal("12345678901234567890.12")
    df = spark.createDataFrame([(big, exact), (None, None)], "n long, d decimal(30,2)")
    filled = missing.fill_median(df, ["n", "d"]).table
    assert [tuple(r) for r in filled.collect()] == [(big, exact), (big, exact)]


def test_sketched_medians_stay_within_their_error(spark):
    """Values that share their doubles, alone or between others, in every layout."""
    rng = random.Random(8)
    data = {
        "close": [9007199254740993 + k for k in range(4000)],
        "ends": [2**62 + k for k in range(3000)] + [-(2**62)] * 500 + [k for k in range(500)],
        "one": [2**60 + 1] * 4000,
        "exact": [Decimal(12345678901234567890) + Decimal(k) / 100 for k in range(4000)],
        "long": [Decimal(10**37 + 7 * k).scaleb(-6) for k in range(4000)],
        "plain": [float(k % 900) for k in range(4000)],
        "few": [k % 3 for k in range(4000)],
    }
    for values in data.values():
        rng.shuffle(values)
    schema = "close long, ends long, one long, exact decimal(30,2), long decimal(38,6), plain double, few int"
    df = spark.createDataFrame(list(zip(*data.values())) + [(None,) * 7], schema).repartition(6)
    for error in (0.01, 0.1):
        filled = missing.fill_median(df, list(data), relative_error=error).table
        held = {c: set(v) for c, v in data.items()}
        row = filled.exceptAll(df).first()
        for name, values in data.items():
            assert row[name] in held[name], name
            less, same = sum(v < row[name] for v in values), sum(v == row[name] for v in values)
            assert less <= (0.5 + error) * len(values) and less + same >= (0.5 - error) * len(values), name
