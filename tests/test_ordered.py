import datetime
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablecraft.functions import ordered, texts


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_a_global_window(spark, descending):
    df = spark.range(20_000).select(
        F.round(F.rand(5) * 1000, 1).alias("v"), (F.col("id") % 3).alias("w")
    ).groupBy("v").agg(F.sum("w").alias("w"))
    order = F.desc("v") if descending else F.asc("v")
    whole = df.withColumn("cum_w", F.sum("w").over(Window.orderBy(order)))
    got = ordered.running_totals(df, "v", ["w"], descending)
    assert got.select("__bucket").distinct().count() > 20
    assert sorted(got.select("v", "cum_w").collect()) == sorted(whole.select("v", "cum_w").collect())
    assert got.select("all_w").distinct().collect()[0][0] == whole.agg(F.sum("w")).first()[0]


def test_running_totals_over_text(spark):
    words = [f"{random.Random(i).random():.6f}" for i in range(3000)]
    df = spark.createDataFrame([(w,) for w in set(words)], "v string").withColumn("one", F.lit(1))
    got = {r.v: r.cum_one for r in ordered.running_totals(df, "v", ["one"]).collect()}
    assert got == {w: i + 1 for i, w in enumerate(sorted(set(words)))}


def test_buckets_of_texts_are_small_and_in_order(spark, monkeypatch):
    """Long shared prefixes, prefixes within prefixes, a frequent digit, and texts that are prefixes of others."""
    monkeypatch.setattr(texts, "BUCKET_TEXTS", 40)
    rng = random.Random(4)
    prefix = "ü" + "same start of all, " * 80
    values = {prefix + f"{k:05d}" for k in range(3000)} | {prefix + "x" * k for k in range(60)}
    values |= {f"{rng.random():.4f}" for _ in range(1500)} | {"", "a", "a\0", "a\0\0", "漢字", "\U0001f600"}
    values |= {"frequent-" + prefix + "/" + "".join(rng.choices("ab", k=14)) for _ in range(1000)}
    df = spark.createDataFrame([(v,) for v in values], "v string").withColumn("one", F.lit(1)).repartition(5)
    rows = texts.split_texts(df, "v", len(values)).collect()
    by_text = sorted(rows, key=lambda r: r.v.encode())
    assert [r["__bucket"] for r in by_text] == sorted(r["__bucket"] for r in rows)
    sizes = Counter(r["__bucket"] for r in rows)
    assert max(sizes.values()) <= 40
    got = {r.v: r.cum_one for r in ordered.running_totals(df, "v", ["one"]).collect()}
    assert got == {r.v: k + 1 for k, r in enumerate(by_text)}
    assert texts.split_texts(df.limit(0), "v", 0).count() == 0


def test_running_totals_over_dates_and_booleans(spark):
    days = [datetime.date(2020, 1, 1) + datetime.timedelta(d) for d in range(0, 900, 7)]
    df = spark.createDataFrame([(d, 1) for d in days], "v date, one int")
    for frame in (df, df.withColumn("v", F.col("v").cast("timestamp")), df.withColumn("v", F.col("v").cast("timestamp_ntz"))):
        got = sorted((r.v, r.cum_one) for r in ordered.running_totals(frame, "v", ["one"]).collect())
        assert [n for _, n in got] == list(range(1, len(days) + 1))


def test_cut_points_ignore_infinities_and_need_no_rows(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),)], "v double")
    assert ordered.cut_points(df, "v") == []
    assert ordered.cut_points(df.limit(0), "v") == []


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    values=st.lists(st.one_of(st.none(), st.integers(-5, 5).map(float), st.floats(-1e6, 1e6)),
                    min_size=1, max_size=60),
    p=st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.9, 1.0]),
)
def test_quantiles_match_pandas(spark, values, p):
    data = pd.DataFrame({"k": [i % 2 for i in range(len(values))], "v": values}, dtype=float)
    df = spark.createDataFrame(
        [(int(k), None if np.isnan(v) else float(v)) for k, v in data.to_numpy()], "k int, v double"
    )
    got = {r.k: r.q for r in ordered.quantiles(df, "v", [p], ["q"], keys=["k"]).collect()}
    want = data.dropna().groupby("k")["v"].quantile(p).to_dict()
    assert set(got) == {int(k) for k in want}
    for key, value in want.items():
        assert got[int(key)] == pytest.approx(value, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("bounded", [True, False])
def test_quantiles_with_a_hot_value_and_null_key(spark, monkeypatch, bounded):
    if not bounded:
        monkeypatch.setattr(ordered, "hold", lambda df: None)
    df = spark.range(30_000).select(
        F.when(F.col("id") % 3 != 0, F.lit("k")).alias("k"),
        F.when(F.col("id") % 2 == 0, F.lit(5.0)).otherwise(F.col("id") / 10).alias("v"),
    )
    got = {r.k: (r.n, r.a, r.b) for r in
           ordered.quantiles(df, "v", [0.3, 0.77], ["a", "b"], keys=["k"]).collect()}
    data = df.toPandas()
    for key, part in [("k", data[data.k == "k"]), (None, data[data.k.isna()])]:
        want = part["v"].quantile([0.3, 0.77])
        assert got[key] == (len(part), pytest.approx(want.iloc[0]), pytest.approx(want.iloc[1]))


def test_frequent_values_have_buckets_of_their_own(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7.0).otherwise(F.rand(3) * 100).alias("v"))
    cuts = ordered.cut_points(df, "v")
    assert 7.0 in cuts and cuts == sorted(set(cuts))
    alone = ordered.with_bucket(df, "v", cuts).where(F.col("__bucket") == cuts.index(7.0) + 1)
    assert alone.select("v").distinct().collect() == [(7.0,)]


def test_quantiles_of_many_groups(spark, monkeypatch, tmp_path):
    """More groups than are held, a hot group and NULL among them; distinct values are shuffled once."""
    monkeypatch.setattr(ordered.hold, "__defaults__", (100,))
    df = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, F.lit(-1)).when(F.col("id") % 7 != 0, F.col("id") % 1500).alias("k"),
        F.round(F.rand(11) * 500, 1).alias("v"),
    )
    df.write.parquet(str(tmp_path / "rows"))
    df = spark.read.parquet(str(tmp_path / "rows"))
    found = ordered.quantiles(df, "v", [0.25, 0.5], ["a", "b"], keys=["k"])
    got = {r.k: (r.n, r.a, r.b) for r in found.collect()}
    data = df.toPandas()
    want = data.groupby("k", dropna=False)["v"].quantile([0.25, 0.5]).unstack()
    sizes = data.groupby("k", dropna=False)["v"].size()
    assert len(got) == len(want) > 1000
    for key, row in want.iterrows():
        n, a, b = got[None if np.isnan(key) else int(key)]
        assert (n, a, b) == (sizes[key], pytest.approx(row[0.25]), pytest.approx(row[0.5]))
