import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from registry import learning
from registry.fixtures import lines
from tablecraft.functions.cluster import fresh_path
from tablecraft.operators import classify, curves, evaluate, forest, split
from tablecraft.plans import training
from tablecraft.sources import models

SF_DIR = "/root/testdata/sf0.001"
NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORICAL = ["l_returnflag", "l_linestatus"]


def rows(df):
    return [tuple(r) for r in df.collect()]


def values(df):
    return {r.metric: r.value for r in df.collect()}


@pytest.fixture(scope="module")
def scored(spark):
    return lines(spark, SF_DIR).select("label", "prediction", "score").persist()


def test_metrics_agree_with_the_evaluators(scored):
    got = values(evaluate.report(scored))
    for ours, theirs in [("accuracy", "accuracy"), ("f1", "f1"), ("weighted_precision", "weightedPrecision"),
                         ("weighted_recall", "weightedRecall"), ("precision", "precisionByLabel"),
                         ("recall", "recallByLabel")]:
        evaluator = MulticlassClassificationEvaluator(metricName=theirs, metricLabel=1.0)
        assert got[ours] == pytest.approx(evaluator.evaluate(scored)), ours
    area = BinaryClassificationEvaluator(rawPredictionCol="score", numBins=0)
    assert got["auc"] == pytest.approx(area.evaluate(scored), abs=1e-12)
    assert got["weighted_recall"] == pytest.approx(got["accuracy"])


def test_metrics_of_more_than_two_classes_and_unpredicted_ones(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2, 2), (2, 0), (1, 2)], "label int, prediction int")
    per_class = {r["class"]: r for r in evaluate.per_class_metrics(df).collect()}
    assert per_class[1.0].precision == 0.0 and per_class[1.0].f1 == 0.0
    assert per_class[2.0].precision == pytest.approx(1 / 3)
    assert sum(r.support for r in per_class.values()) == 5
    wide = {r.label: r.asDict() for r in evaluate.confusion_wide(df, [0, 1, 2]).collect()}
    assert wide[1.0] == {"label": 1.0, "predicted_0": 0, "predicted_1": 0, "predicted_2": 2}
    assert evaluate.confusion_wide(df).columns == ["label", "predicted_0", "predicted_2"]


def test_wide_confusion_of_missing_large_and_no_predictions(spark):
    df = spark.createDataFrame([(1.0, None), (1.0, 1234567.0), (0.5, 1234568.0)], "label double, prediction double")
    wide = {r.label: r.asDict() for r in evaluate.confusion_wide(df).collect()}
    assert wide[1.0] == {"label": 1.0, "predicted_1234567": 1, "predicted_1234568": 0, "predicted_none": 1}
    assert wide[0.5]["predicted_1234568"] == 1
    assert evaluate.confusion_wide(df.limit(0)).collect() == []


def test_importance_refuses_names_that_do_not_fit(spark, monkeypatch):
    df = spark.createDataFrame([(1.0, 2.0, 0.0), (2.0, 1.0, 1.0)] * 20, "a double, b double, label double")
    model = classify.fit(df, "logistic", ["a", "b"])
    monkeypatch.setattr(classify, "feature_names", lambda *_: ["a"])
    with pytest.raises(ValueError, match="weighs 2"):
        classify.feature_importance(model, df)


def test_curves_start_and_end_where_they_should(scored):
    points = sorted(curves.roc(scored).collect(), key=lambda r: -r.threshold)
    assert tuple(points[0]) == (float("inf"), 0.0, 0.0)
    assert (points[-1].fpr, points[-1].tpr) == (1.0, 1.0)
    assert all(a.fpr <= b.fpr and a.tpr <= b.tpr for a, b in zip(points, points[1:]))
    area = np.trapezoid([p.tpr for p in points], [p.fpr for p in points])
    assert curves.auc(scored).first().auc == pytest.approx(area)
    precision = curves.pr(scored)
    assert precision.count() == len(points) - 1
    assert (None, 0.0, 1.0) in rows(curves.pr(scored, end_point=True))


def test_collinear_points_are_dropped_across_buckets(spark):
    # Positives only above, negatives only below: the curve has one corner and one end.
    df = spark.range(20_000).select(
        (F.col("id") >= 10_000).cast("double").alias("label"), (F.col("id") / 7).alias("score")
    )
    got = {(r.fpr, r.tpr) for r in curves.roc(df, drop_collinear=True).collect()}
    assert got == {(0.0, 0.0), (0.0, 1.0), (1.0, 1.0)}
    assert curves.roc(df).count() == 20_001
    assert curves.auc(df).first().auc == 1.0


def test_curves_of_one_class_or_no_rows(spark):
    df = spark.createDataFrame([(1.0, 0.5), (1.0, 0.7)], "label double, score double")
    assert curves.auc(df).first().auc is None
    assert {r.fpr for r in curves.roc(df).collect() if r.threshold < 1} == {None}
    assert curves.auc(df.limit(0)).first().auc is None
    assert rows(curves.roc(df.limit(0))) == [(float("inf"), 0.0, 0.0)]


def test_positive_score_of_vectors_and_short_vectors(spark):
    df = spark.createDataFrame([(Vectors.dense(0.2, 0.8),), (Vectors.dense(1.0),)], ["probability"])
    assert [r.score for r in evaluate.positive_score(df, "probability").collect()] == [0.8, None]


@pytest.mark.parametrize(
    "learner, encoding, params",
    [
        ("logistic", "index", {}),
        ("logistic", "onehot", {}),
        ("random_forest", "index", {"numTrees": 10, "maxDepth": 4}),
        ("linear_svm", "onehot", {"maxIter": 20}),
        ("gbt", "index", {"maxDepth": 3, "maxIter": 5}),
    ],
)
def test_learners_find_the_signal(spark, learner, encoding, params):
    found = training.run(
        lines(spark, SF_DIR), NUMERIC, CATEGORICAL, "label", learner,
        key=["l_orderkey", "l_linenumber"], encoding=encoding, **params,
    )
    assert values(found.metrics)["auc"] > 0.65
    assert sum(r["count"] for r in found.confusion.collect()) == found.scored.count()
    ranked = found.importance.collect()
    names = [r.feature for r in ranked]
    assert len(ranked) == (6 if encoding == "index" else 9)
    assert "l_quantity" in names and len(set(names)) == len(names)
    assert sum(r.importance_pct for r in ranked) == pytest.approx(100.0)
    assert [r.importance for r in ranked] == sorted((r.importance for r in ranked), reverse=True)
    found.scored.unpersist()


def test_learners_are_compared_on_rows_divided_once(spark, monkeypatch):
    wanted = {name: values(learning._trained(spark, SF_DIR, name).metrics) for name in ("logistic", "linear_svm")}
    calls = []
    divide = split.hash_split
    monkeypatch.setattr(split, "hash_split", lambda *given: (calls.append(1), divide(*given))[1])
    monkeypatch.setattr(learning, "LEARNERS", tuple(wanted))
    got = learning.compare_learners(spark, SF_DIR).collect()
    assert len(calls) == 1 and len(got) == 14
    assert all(r.value == pytest.approx(wanted[r.model][r.metric], abs=1e-4) for r in got)
    spark.catalog.clearCache()


def test_names_follow_vector_order_when_a_category_comes_first(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    df = spark.createDataFrame([("a", 1.0, 0.0), ("b", 2.0, 1.0)] * 20, "c string, n double, label double")
    model = Pipeline(
        stages=[
            StringIndexer(inputCol="c", outputCol="c_encoded"),
            VectorAssembler(inputCols=["c_encoded", "n"], outputCol="features"),
            classify.make_learner("logistic"),
        ]
    ).fit(df)
    assert classify.feature_names(model, df) == ["c_encoded", "n"]


def test_saved_models_score_alike_and_are_not_overwritten_by_accident(spark, tmp_path):
    path = str(tmp_path / "model")
    found = training.run(
        lines(spark, SF_DIR), NUMERIC, CATEGORICAL, "label", "linear_svm",
        key=["l_orderkey", "l_linenumber"], save_to=path, maxIter=10,
    )
    _, test = split.hash_split(lines(spark, SF_DIR), ["l_orderkey", "l_linenumber"])
    again = classify.score(models.load(path), test, "linear_svm")
    columns = ["l_orderkey", "l_linenumber", "prediction", F.round("score", 9).alias("score")]
    assert sorted(rows(again.select(*columns))) == sorted(rows(found.scored.select(*columns)))
    with pytest.raises(Exception, match="(?i)exist"):
        models.save(found.model, path)
    models.save(found.model, path, overwrite=True)


def test_unseen_categories_and_missing_rows_at_scoring(spark):
    df = spark.createDataFrame(
        [("a", 1.0, 0.0), ("b", 2.0, 1.0)] * 30, "c string, n double, label double"
    )
    model = classify.fit(df, "logistic", ["n"], ["c"])
    later = spark.createDataFrame([("zz", 1.0), ("a", 2.0)], "c string, n double")
    assert classify.score(model, later).count() == 2


def test_bins_grow_with_the_largest_category(spark):
    df = spark.range(400).select(
        F.concat(F.lit("c"), F.col("id") % 80).alias("c"), (F.col("id") % 2).cast("double").alias("label"),
        F.rand(1).alias("n"),
    )
    model = classify.fit(df, "random_forest", ["n"], ["c"], numTrees=2, maxDepth=2)
    assert model.stages[-1].getOrDefault("maxBins") == 81
    asked = classify.fit(df, "random_forest", ["n"], ["c"], numTrees=2, maxDepth=2, maxBins=32)
    assert asked.stages[-1].getOrDefault("maxBins") == 81


def test_unknown_learners(spark):
    with pytest.raises(ValueError, match="learner must be"):
        classify.make_learner("perceptron")


def test_random_split_is_used_without_a_key(spark):
    found = training.run(lines(spark, SF_DIR), NUMERIC, [], "label", "logistic", maxIter=5)
    assert 0.1 < found.scored.count() / 6000 < 0.3


def test_written_paths_lie_in_the_named_folder(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    path = fresh_path(spark, "x")
    assert path != fresh_path(spark, "x")
    if named:
        assert path.startswith(named.rstrip("/") + "/")


def _few_values(spark, n):
    """Rows of features with few values each, so that bins are the same however rows are drawn."""
    digits = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10).cast("long")
    made = spark.range(n).select("id", digits.alias("d"))
    return made.select(
        (F.col("d") % 7).cast("int").alias("a"), ((F.col("d") / 7).cast("long") % 11 / 4.0).alias("b"),
        F.concat(F.lit("c"), (F.col("d") / 77).cast("long") % 3).alias("c"),
        ((F.col("d") % 7) * 3 + (F.col("d") / 77).cast("long") % 3 * 4 + F.col("id") % 13 > 20).cast("double").alias("label"),
    )


def test_boosted_trees_of_many_rows_are_those_of_all_rows(spark, monkeypatch):
    train = _few_values(spark, 4000).persist()
    plain = classify.fit(train, "gbt", ["a", "b"], ["c"], maxDepth=4, maxIter=6)
    sizes = []
    fit = classify.GBTClassifier.fit
    monkeypatch.setattr(classify.GBTClassifier, "fit", lambda self, df: (sizes.append(df.count()), fit(self, df))[1])
    monkeypatch.setattr(classify, "ROWS_AS_THEY_ARE", 1000)
    made = classify.fit(train, "gbt", ["a", "b"], ["c"], maxDepth=4, maxIter=6)
    assert sizes[0] == train.distinct().count() < 500
    again, before = classify.score(made, train), classify.score(plain, train)
    assert again.columns == before.columns
    key = ["a", "b", "c", "prediction", F.round("score", 9).alias("score")]
    assert sorted(rows(again.select(key).distinct())) == sorted(rows(before.select(key).distinct()))
    weights = [{r.feature: round(r.importance, 9) for r in classify.feature_importance(m, train).collect()} for m in (made, plain)]
    assert weights[0] == weights[1] and set(weights[0]) == {"a", "b", "c_encoded"}
    # What depends on the number of rows, or is drawn from them, sees all rows.
    classify.fit(train, "gbt", ["a", "b"], ["c"], maxDepth=2, maxIter=1, minInstancesPerNode=5)
    assert sizes[1] == 4000
    train.unpersist()


def test_bins_cut_all_rows_and_leave_missing_ones_out(spark, monkeypatch):
    values = [float(i) for i in range(1000)] + [float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(v, 1, i % 3) for i, v in enumerate(values)], "`x y` double, one int, few int")
    names, (stage,) = classify._bins(df.na.drop(), ["x y", "one", "few"], 10)
    assert names == ["__bin_x y", "one", "__bin_few"]
    got = stage.transform(df).groupBy("__bin_x y").agg(F.count("*").alias("n"), F.max("x y").alias("m")).collect()
    counts = {r[0]: r["n"] for r in got}
    assert counts.pop(None) == 2 and sorted(counts) == [float(i) for i in range(10)]
    assert all(90 <= n <= 112 for n in counts.values())
    assert stage.transform(df).where(F.col("few") != F.col("__bin_few")).count() == 0
    assert classify._between([0.0, 1.0, float("inf")]) == [0.5, float("inf")]
    assert classify._between([1.0, 1.0000000000000002]) == [1.0000000000000002]


def test_large_forests_are_fitted_some_trees_at_a_time(spark, monkeypatch, tmp_path):
    train = _few_values(spark, 2000).persist()
    sizes = []
    fit = classify.RandomForestClassifier.fit
    monkeypatch.setattr(
        classify.RandomForestClassifier, "fit", lambda self, df: (sizes.append(self.getNumTrees()), fit(self, df))[1]
    )
    whole = classify.fit(train, "random_forest", ["a", "b"], ["c"], numTrees=20, maxDepth=4)
    assert sizes == [20]
    monkeypatch.setattr(classify, "FOREST_COUNTERS", 2000 * 6)
    monkeypatch.setattr(classify, "FOREST_TREES", 4)
    model = classify.fit(train, "random_forest", ["a", "b"], ["c"], numTrees=20, maxDepth=4)
    assert sizes[1:] == [5, 5, 5, 5]
    forest = model.stages[-1]
    assert forest.getNumTrees == 20 == len(forest.trees) and forest.getOrDefault("numTrees") == 20
    assert len({t.toDebugString.split("\n", 1)[1] for t in forest.trees}) > 5
    assert sum(forest.featureImportances.toArray()) == pytest.approx(1.0)
    areas = [values(evaluate.report(classify.score(m, train)))["auc"] for m in (whole, model)]
    assert areas[0] == pytest.approx(areas[1], abs=0.02)
    models.save(model, str(tmp_path / "forest"))
    key = ["a", "b", "c", "prediction", F.round("score", 9)]
    again = classify.score(models.load(str(tmp_path / "forest")), train).select(key).distinct()
    assert sorted(rows(again)) == sorted(rows(classify.score(model, train).select(key).distinct()))
    train.unpersist()


def _as_counted(monkeypatch, rows_kept, blocks=3):
    """Forests of more rows than these are fitted to counted rows, which fill more than one block."""
    monkeypatch.setattr(classify, "ROWS_AS_THEY_ARE", rows_kept)
    monkeypatch.setattr(classify, "FOREST_COUNTERS", rows_kept)
    monkeypatch.setattr(forest, "BLOCK_ROWS", 40)
    monkeypatch.setattr(forest, "MOST_BLOCKS", blocks)


def test_large_forests_are_fitted_to_counted_rows(spark, monkeypatch, tmp_path):
    train = _few_values(spark, 4000).withColumn("one", F.lit(1e12)).withColumn("yes", F.col("a") > 3).persist()
    given = (["a", "b", "one", "yes"], ["c"])
    plain = classify.fit(train, "random_forest", *given, numTrees=10, maxDepth=4, minInfoGain=0.001)
    _as_counted(monkeypatch, 1000)
    with monkeypatch.context() as only:
        only.setattr(classify.RandomForestClassifier, "fit", lambda *_: pytest.fail("rows are read one by one"))
        model = classify.fit(train, "random_forest", *given, numTrees=10, maxDepth=4, minInfoGain=0.001)
        again = classify.fit(train.repartition(5), "random_forest", *given, numTrees=10, maxDepth=4, minInfoGain=0.001)
    fitted = model.stages[-1]
    assert fitted.getNumTrees == 10 == len(fitted.trees) and fitted.getOrDefault("maxDepth") == 4
    texts = [[t.toDebugString.split("\n", 1)[1] for t in m.stages[-1].trees] for m in (model, again)]
    assert texts[0] == texts[1] and len(set(texts[0])) > 5 and max(t.depth for t in fitted.trees) == 4
    areas = [values(evaluate.report(classify.score(m, train)))["auc"] for m in (plain, model)]
    assert areas[0] == pytest.approx(areas[1], abs=0.03)
    weights = [{r.feature: r.importance for r in classify.feature_importance(m, train).collect()} for m in (model, plain)]
    assert weights[0].keys() == weights[1].keys() == {"a", "b", "one", "yes", "c_encoded"}
    assert sum(weights[0].values()) == pytest.approx(1.0)
    # What one of the first two tells of the label the other does too, so trees take turns.
    assert weights[0]["one"] == 0 and min(weights[0]["a"], weights[0]["yes"]) > weights[0]["b"]
    assert weights[0]["c_encoded"] == pytest.approx(weights[1]["c_encoded"], abs=0.1)
    drawn = [sum(n for n in t._call_java("rootNode").impurityStats().stats()) for t in fitted.trees]
    assert np.mean(drawn) == pytest.approx(0.8 * 4000, rel=0.02) and np.std(drawn) == pytest.approx(3200**0.5, rel=0.9)
    models.save(model, str(tmp_path / "counted"))
    key = ["a", "b", "c", "prediction", F.round("score", 9)]
    loaded = classify.score(models.load(str(tmp_path / "counted")), train).select(key).distinct()
    assert sorted(rows(loaded)) == sorted(rows(classify.score(model, train).select(key).distinct()))
    train.unpersist()


@pytest.mark.parametrize("change", [{"minInfoGain": 0.0}, {"impurity": "entropy"}, {"maxBins": 300}, {"bootstrap": False}])
def test_forests_that_counted_rows_cannot_give_are_sparks(spark, monkeypatch, change):
    train = _few_values(spark, 600).persist()
    _as_counted(monkeypatch, 100)
    monkeypatch.setattr(forest, "fit", lambda *_: pytest.fail("not the same forest"))
    assert classify.fit(train, "random_forest", ["a"], ["c"], numTrees=3, maxDepth=2, **change).stages[-1].getNumTrees == 3
    three = train.withColumn("label", (F.col("a") % 3).cast("double"))
    assert classify.fit(three, "random_forest", ["a"], numTrees=3, maxDepth=2).stages[-1].numClasses == 3
    train.unpersist()


@pytest.mark.parametrize("settings", [{"maxDepth": 8}, {"maxDepth": 2}, {"maxDepth": 8, "minInstancesPerNode": 200}])
def test_trees_of_counted_rows_are_those_of_the_drawn_rows(spark, monkeypatch, settings):
    settings = {"minInfoGain": 0.0005, "minInstancesPerNode": 10, **settings}
    df = _few_values(spark, 6000).select("a", (F.col("b") * 4).alias("b"), F.substring("c", 2, 1).cast("int").alias("c"), "label")
    features = [forest.Feature(F.col("a"), None, False), forest.Feature(F.col("b"), None, False), forest.Feature(F.col("c"), 4, True)]
    monkeypatch.setattr(forest, "COUNTS_AT_ONCE", 1)
    monkeypatch.setattr(forest, "PIECE", 3)
    model = forest.fit(df, features, classify.make_learner("random_forest", numTrees=1, **settings))
    cells = np.array(sorted(tuple(map(int, r)) for r in df.groupBy("a", "b", "c", "label").count().collect())).T
    cells = cells[:, np.lexsort(cells)]
    drawn = np.repeat(cells[:4], np.random.default_rng([42, 0, 0]).poisson(0.8 * cells[4]), axis=1).astype(float)
    listed = spark.createDataFrame(drawn.T.tolist(), "a double, b double, c double, label double")
    index = StringIndexerModel.from_labels(["0.0", "1.0", "2.0"], inputCol="c", outputCol="i", handleInvalid="keep")
    data = VectorAssembler(inputCols=["a", "b", "i"], outputCol="features").transform(index.transform(listed))
    tree = DecisionTreeClassifier(**settings).fit(data)
    assert model.trees[0].toDebugString.split("\n", 1)[1] == tree.toDebugString.split("\n", 1)[1]
    assert tree.numNodes >= 3 and model.featureImportances.toArray() == pytest.approx(tree.featureImportances.toArray())
    got, wanted = (rows(m.transform(data).select("prediction", "probability")) for m in (model, tree))
    assert got == wanted


@pytest.mark.parametrize("classes, fits", [(2, 1), (3, 3)])
def test_two_classes_of_the_svm_are_one_fit(spark, monkeypatch, classes, fits):
    df = _few_values(spark, 600).withColumn("label", (F.col("a") % classes).cast("double")).persist()
    learner = classify.make_learner("linear_svm", maxIter=10)
    whole = learner.fit(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df))
    done = []
    fit = classify.LinearSVC._fit
    monkeypatch.setattr(classify.LinearSVC, "_fit", lambda self, data: (done.append(1), fit(self, data))[1])
    model = classify.fit(df, "linear_svm", ["a", "b"], scale=False, maxIter=10)
    assert len(done) == fits and len(model.stages[-1].models) == classes
    for ours, theirs in zip(model.stages[-1].models, whole.models):
        assert ours.coefficients.toArray() == pytest.approx(theirs.coefficients.toArray(), abs=1e-9)
        assert ours.intercept == pytest.approx(theirs.intercept, abs=1e-9)
    got = [rows(m.select("prediction", "rawPrediction")) for m in (
        model.transform(df), whole.transform(VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)))]
    assert [p for p, _ in got[0]] == [p for p, _ in got[1]]
    df.unpersist()
