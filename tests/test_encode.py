import datetime

import numpy as np
import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablecraft.operators import classify, encode, features, scale, split
from tablecraft.plans import preparation


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.createDataFrame(
        [(1, "b", 10.0), (2, "a", 9.0), (3, None, 100.0), (4, "b", None)], "id int, s string, d double"
    )


def test_labels_keep_place_order_numbers_by_value_and_put_null_last(mixed):
    coded = encode.label_encode(mixed, ["s", "d"])
    assert coded.columns == mixed.columns
    assert rows(coded) == [(1, 1.0, 1.0), (2, 0.0, 0.0), (3, 2.0, 2.0), (4, 1.0, 3.0)]
    added = encode.label_encode(mixed, ["s"], suffix="_code")
    assert added.columns == ["id", "s", "d", "s_code"]


def test_labels_agree_with_string_indexer(mixed):
    indexer = StringIndexer(inputCol="s", outputCol="i", stringOrderType="alphabetAsc", handleInvalid="keep")
    want = indexer.fit(mixed).transform(mixed).select("id", "i")
    got = encode.label_encode(mixed, ["s"]).select("id", "s")
    assert rows(got) == rows(want)


def test_labels_of_dates_and_booleans(spark):
    days = [datetime.date(2024, 1, d) for d in (9, 10, 1)]
    df = spark.createDataFrame([(d, d.day > 5) for d in days], "t date, b boolean")
    assert rows(encode.label_encode(df, ["t", "b"])) == [(1.0, 1.0), (2.0, 1.0), (0.0, 0.0)]


@pytest.mark.parametrize("kind", ["string", "double"])
def test_many_labels_with_a_hot_value_match_the_list_form(spark, kind):
    value = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.col("id"))
    df = spark.range(5_000).select("id", value.cast(kind).alias("v"))
    listed = encode.label_encode(df, ["v"])
    joined = encode.label_encode(df, ["v"], max_labels=10)
    assert joined.columns == df.columns
    assert sorted(rows(listed)) == sorted(rows(joined))


def test_both_label_paths_agree_on_odd_doubles(spark):
    odd = [1.0, float("nan"), None, -0.0, 0.0, float("inf"), -2.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "id int, v double")
    listed, joined = encode.label_encode(df, ["v"]), encode.label_encode(df, ["v"], max_labels=1)
    want = {0: 2.0, 1: 4.0, 2: 4.0, 3: 1.0, 4: 1.0, 5: 3.0, 6: 0.0}
    assert {r.id: r.v for r in listed.collect()} == want == {r.id: r.v for r in joined.collect()}


def test_onehot_of_booleans_dates_and_long_texts(spark):
    long = "x" * 1_001
    df = spark.createDataFrame(
        [(True, datetime.date(2024, 1, 9), long), (False, datetime.date(2024, 1, 1), "a"), (None, None, None)],
        "b boolean, t date, s string",
    )
    assert encode.onehot(df, ["s"]).columns == ["b", "t", "s", "s_a"]
    coded = encode.onehot_vector(df, ["b", "t", "s"], drop_last=False)
    got = [tuple(list(v) for v in r) for r in coded.select("b_ohe", "t_ohe", "s_ohe").collect()]
    assert got == [([0, 1], [0, 1], [0, 1]), ([1, 0], [1, 0], [1, 0]), ([0, 0], [0, 0], [0, 0])]


def test_scalers_fitted_once_scale_later_tables(spark):
    first = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    later = spark.createDataFrame([(2.0,), (5.0,), (None,)], "x double")
    standard, minmax = scale.fit_standard(first, ["x"]), scale.fit_minmax(first, ["x"])
    assert [r.x_minmax for r in minmax.columns(later).collect()] == [0.5, 2.0, None]
    assert [r.x_standard for r in standard.columns(later).collect()][0] == 0.0
    assert standard.vector(later, "skip").count() == 2


def test_onehot_columns_arrays_and_limits(mixed):
    coded = encode.onehot(mixed, ["s"], unknown=True).drop("d")
    assert coded.columns == ["id", "s", "s_a", "s_unknown"]
    assert [r[2:] for r in rows(coded)] == [(0, 0), (1, 0), (0, 1), (0, 0)]
    arrays = encode.onehot(mixed, ["s"], drop_last=False, as_array=True)
    assert [r.s_ohe for r in arrays.collect()] == [[0, 1], [1, 0], [0, 0], [0, 1]]
    both = encode.onehot(mixed, ["s", "d"], drop_last=False)
    assert {"s_a", "s_b", "d_9.0", "d_10.0", "d_100.0"} <= set(both.columns)
    with pytest.raises(ValueError, match="onehot_vector"):
        encode.onehot(mixed, ["s"], max_columns=1)


def test_onehot_vector_width_is_fixed_at_fitting(spark, mixed):
    for drop_last, width in [(True, 1), (False, 2)]:
        fitted = encode.fit_onehot_vector(mixed, ["s"], drop_last)
        later = spark.createDataFrame([(9, "zz", 1.0), (8, "a", 1.0), (7, None, 1.0)], mixed.schema)
        got = [list(r.s_ohe) for r in fitted.transform(later).collect()]
        assert {len(v) for v in got} == {width}
        assert got[0] == [0.0] * width and got[2] == [0.0] * width and got[1][0] == 1.0


def test_scalers_agree_with_their_column_form_and_treat_constants(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (4.0, 5)], "x double, k int")
    for scaler, output, suffix, constant in [
        (scale.standard, scale.STANDARD_OUTPUT, "standard", 0.0),
        (scale.minmax, scale.MINMAX_OUTPUT, "minmax", 0.5),
    ]:
        vectors = [list(r[0]) for r in scaler(df, ["x", "k"]).select(vector_to_array(output)).collect()]
        columns = [list(r)[2:] for r in scaler(df, ["x", "k"], as_columns=True).collect()]
        assert np.allclose(vectors, columns)
        assert {c[1] for c in columns} == {constant}
        assert scaler(df, ["x"], as_columns=True).columns == ["x", "k", f"x_{suffix}"]


def test_scalers_and_missing_values(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    with pytest.raises(Exception):
        scale.standard(df, ["x"]).collect()
    assert scale.standard(df, ["x"], on_missing="skip").count() == 2
    assert [r.x_minmax for r in scale.minmax(df, ["x"], 0, 10, as_columns=True).collect()] == [0.0, None, 10.0]
    assert scale.minmax(df, ["nope"], strict=False).columns == ["x"]


def test_assemble_replaces_its_output_and_follows_on_missing(mixed):
    once = features.assemble(mixed, ["id", "d"])
    assert features.assemble(once, ["id", "d"]).count() == 3
    with pytest.raises(Exception):
        features.assemble(mixed, ["d"], on_missing="error").collect()
    kept = features.assemble(mixed, ["d"], on_missing="keep").select(vector_to_array("features")).collect()
    assert np.isnan(kept[3][0][0])
    with pytest.raises(ValueError, match="kind"):
        features.assemble(mixed, ["s"])


def test_build_drops_rows_missing_a_used_column_only(spark):
    df = spark.createDataFrame(
        [(1.0, "a", 1, None), (2.0, "b", 0, "x"), (None, "a", 1, "x"), (4.0, None, 1, "x"), (5.0, "b", None, "x")],
        "n double, c string, y int, unused string",
    )
    made, _ = features.build(df, ["n"], ["c"], "y")
    got = [(r.label, list(r.features)) for r in made.collect()]
    assert got == [(1.0, [1.0, 0.0]), (0.0, [2.0, 1.0])]
    wide, _ = features.build(df, ["n"], ["c"], "y", encoding="onehot")
    assert [list(r.features) for r in wide.collect()] == [[1.0, 1.0, 0.0], [2.0, 0.0, 1.0]]
    scaled, _ = features.build(df, ["n"], [], "y", scale=True)
    assert np.mean([r.features[0] for r in scaled.collect()]) == pytest.approx(0.0)


def test_splits(spark):
    df = spark.range(2_000).withColumnRenamed("id", "k")
    train, test = split.hash_split(df, "k", 0.7, seed=1)
    again, _ = split.hash_split(df.repartition(5), ["k"], 0.7, seed=1)
    assert train.count() + test.count() == 2_000
    assert 0.65 < train.count() / 2_000 < 0.75
    assert sorted(rows(train)) == sorted(rows(again))
    assert sorted(rows(split.hash_split(df, "k", 0.7, seed=2)[0])) != sorted(rows(train))
    first, second = split.random_split(df)
    assert first.count() + second.count() == 2_000 and first.intersect(second).count() == 0


def test_preparation_reports_every_step(mixed):
    done, told = preparation.run(
        mixed,
        [("fill_mean", {"cols": ["d"]}), ("fill_mode", {"cols": ["s"]}), ("onehot", {"cols": ["s"]}),
         ("drop_duplicates", {"cols": ["s"], "keep_by": ["id"]})],
    )
    assert done.count() == 2 and "s_a" in done.columns
    assert [r.step for r in told.select("number", "step").distinct().orderBy("number").collect()] == [
        "fill_mean", "fill_mode", "onehot", "drop_duplicates"
    ]
    steps = [("drop_duplicates", {"cols": ["s"], "keep_by": ["id"]}), ("onehot_vector", {"cols": ["s"]}),
             ("label_encode", {"cols": ["s"]})]
    plain = preparation.run(mixed, steps).table
    stored = preparation.run(mixed, steps, write_after=["drop_duplicates", "onehot_vector"]).table
    assert plain.schema == stored.schema
    assert sorted(map(str, rows(plain))) == sorted(map(str, rows(stored)))
    unchanged, nothing = preparation.run(mixed, [])
    assert unchanged is mixed and nothing.count() == 0
    with pytest.raises(ValueError, match="step must be"):
        preparation.run(mixed, [("melt", {})])


def test_hashed_categories_have_no_limit(spark):
    """A million categories, hashed: features, a forest with 32 bins, and the report."""
    df = spark.range(1_000_000).select(
        F.concat(F.lit("name "), F.col("id")).alias("s"), (F.col("id") % 7).cast("double").alias("x"),
        (F.col("id") % 7 > 3).cast("int").alias("y"),
    )
    made, fitted = features.build(df, ["x"], ["s"], label_col="y", encoding="onehot", hash_width=500)
    assert made.select("features").first()[0].size == 501
    told = encode.hash_report(df, ["s"], 500).first()
    assert (told.categories, told.slots_used, told.sharing) == (1_000_000, 500, 1_000_000)
    few = df.where("x < 6").limit(20_000)
    model = classify.fit(
        few.withColumnRenamed("y", "label"), "random_forest", ["x"], ["s"], hash_width=32, numTrees=3, maxDepth=3
    )
    assert model.stages[-1].getMaxBins() == 32
    scored = classify.score(model, few)
    assert scored.where("prediction <> y").count() == 0
    # Scoring a scored table again replaces what the stages added.
    assert classify.score(model, scored).columns == scored.columns
    assert {r.feature for r in classify.feature_importance(model, few).collect()} == {"x", "s_encoded"}


def test_hash_slots_and_missing_values(mixed):
    coded = encode.hash_encode(mixed, ["s", "d"], 4)
    assert coded.columns == mixed.columns
    got = rows(coded)
    assert got[2][1] == 4.0 and got[3][2] == 4.0 and got[0][1] == got[3][1]
    assert all(0 <= v <= 4 for row in got for v in row[1:])
    wide = encode.onehot_vector(mixed, ["s"], hash_width=4)
    for row in wide.withColumn("a", vector_to_array("s_ohe")).collect():
        assert len(row.a) == 4 and sum(row.a) == (row.s is not None)
    again = encode.hash_encode(mixed, ["s"], 4, suffix="_slot")
    assert [r.s_slot for r in again.collect()] == [r[1] for r in got]
    with pytest.raises(ValueError, match="hash_width"):
        encode.hash_encode(mixed, ["s"], 0)


def test_limits_of_lists_are_the_callers(mixed):
    labelled = mixed.withColumn("label", F.col("id") % 2)
    for call in (
        lambda n: features.build(labelled, ["id"], ["s"], max_labels=n),
        lambda n: features.pipeline(labelled, ["id"], ["s"], max_labels=n),
        lambda n: encode.onehot_vector(labelled, ["s"], max_labels=n),
        lambda n: classify.fit(labelled, "logistic", ["id"], ["s"], max_labels=n),
    ):
        with pytest.raises(ValueError, match="max_labels"):
            call(1)
        call(2)
