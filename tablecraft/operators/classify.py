"""Fitting, scoring and explaining classifiers: one flow, several learners."""

from __future__ import annotations

import random
from collections.abc import Mapping, Sequence
from typing import Any

import numpy as np
from pyspark import SparkContext, StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    GBTClassifier,
    LinearSVC,
    LinearSVCModel,
    LogisticRegression,
    OneVsRest,
    OneVsRestModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.common import _py2java
from pyspark.ml.feature import SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.functions.cluster import enable_checkpoints, local_table
from tablecraft.functions.columns import quoted, ref
from tablecraft.operators import forest
from tablecraft.operators.encode import MAX_LABELS
from tablecraft.operators.evaluate import positive_score
from tablecraft.operators.features import TEXT_PREFIX, fit_indexers, stages

# Parameters each learner is fitted with unless told otherwise.
DEFAULTS: dict[str, dict[str, Any]] = {
    "logistic": {"maxIter": 100, "regParam": 0.01, "elasticNetParam": 0.0},
    "random_forest": {
        "numTrees": 200,
        "maxDepth": 15,
        "minInstancesPerNode": 10,
        "minInfoGain": 0.01,
        "impurity": "gini",
        "subsamplingRate": 0.8,
        "seed": 42,
        "cacheNodeIds": True,
        "maxBins": 32,
    },
    "linear_svm": {
        "maxIter": 100,
        "regParam": 0.1,
        "tol": 1e-6,
        "fitIntercept": True,
        "standardization": False,
    },
    "gbt": {"maxDepth": 6, "stepSize": 0.1, "maxIter": 100, "seed": 42},
}
SCORE_COLUMN = {"linear_svm": "rawPrediction"}
TREES = ("random_forest", "gbt")
#: Rows times trees of one forest fit: Spark keeps a counter and a node for each of them.
FOREST_COUNTERS = 400_000_000
#: Trees that are always fitted together, so that reading the rows is not most of the work.
FOREST_TREES = 16
#: Boosted trees are fitted to rows as they are up to here, beyond to rows that share all bins;
#: so are forests of more counters than those above.
ROWS_AS_THEY_ARE = 100_000
#: Settings of a forest fitted to counted rows, and most bins of it.
COUNTED_FOREST = {*DEFAULTS["random_forest"], "maxMemoryInMB", "checkpointInterval"}
COUNTED_BINS = 256
#: Weighted rows of one task.
WEIGHTED_ROWS = 200_000
#: Columns with the bins of numbers.
BIN_PREFIX = "__bin_"
#: Relative error in rank of the borders of bins.
BORDER_ERROR = 0.001


def make_learner(learner: str, **params: Any):
    """An unfitted classifier on ``features`` and ``label``."""
    if learner not in DEFAULTS:
        raise ValueError(f"learner must be one of {', '.join(DEFAULTS)}, not {learner}")
    settings = {**DEFAULTS[learner], **params}
    if learner == "logistic":
        return LogisticRegression(**settings)
    if learner == "random_forest":
        return RandomForestClassifier(**settings)
    if learner == "linear_svm":
        return OneVsRest(classifier=LinearSVC(**settings), parallelism=2)
    return GBTClassifier(**settings)


def fit(
    train: DataFrame,
    learner: str,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    encoding: str = "index",
    scale: bool | None = None,
    max_labels: int = MAX_LABELS,
    hash_width: int | None = None,
    **params: Any,
) -> PipelineModel:
    """Fit feature stages and learner together on training rows with a ``label``.

    Features are standardised for the linear SVM by default. Tree learners get
    as many bins as the largest listed category needs. With ``hash_width`` categories are
    hashed to that many slots, which trees split like numbers, so that any number of
    categories goes with the bins asked for. Rows missing a feature or the label are left out.

    Trees see numbers by their bins only, so of many rows those with the same bins and label are
    fitted as one with their number as weight, or by forests with as many draws. Large forests that
    cannot be fitted so are fitted some trees at a time.
    """
    scale = learner == "linear_svm" if scale is None else scale
    needed = [*numeric, *categorical, "label"]
    rows = train.select(*needed).na.drop()
    if learner in TREES:
        enable_checkpoints(train.sparkSession)
    indexers = fit_indexers(rows, categorical, encoding, max_labels, hash_width)
    if learner in TREES and encoding == "index":
        asked = params.get("maxBins", DEFAULTS[learner].get("maxBins", 32))
        params = {**params, "maxBins": max(asked, _largest_category(indexers))}
    count = rows.count() if learner in TREES else 0
    many = learner in TREES and not scale and count > ROWS_AS_THEY_ARE
    listed = encoding == "index" and hash_width is None
    counted = many and learner == "random_forest" and listed and _by_count(rows, count, params)
    binned = counted or (many and learner == "gbt" and _by_weight(params))
    names, first = _bins(rows, numeric, params.get("maxBins", 32)) if binned else (list(numeric), [])
    built = stages(names, categorical, encoding, scale, indexers=indexers, hash_width=hash_width)
    prepared = Pipeline(stages=[*first, *built]).fit(rows)
    if counted:
        # All but the vector itself.
        parts = PipelineModel(stages=prepared.stages[:-1]).transform(rows)
        seen = _numbers(parts, names, indexers)
        return PipelineModel(stages=[*prepared.stages, forest.fit(parts, seen, make_learner(learner, **params))])
    data = prepared.transform(rows).select("features", "label")
    if binned:
        fitted = _fit_weighted(data, make_learner(learner, **params))
    elif learner == "random_forest":
        fitted = _fit_forest(_spread(data), count, params)
    elif learner == "linear_svm":
        fitted = _fit_rest(_spread(data), make_learner(learner, **params))
    else:
        fitted = make_learner(learner, **params).fit(_spread(data))
    return PipelineModel(stages=[*prepared.stages, fitted])


def _by_weight(params: Mapping[str, Any]) -> bool:
    """Whether a row of weight n is fitted like n rows: nothing is drawn from rows and none are counted."""
    return params.get("subsamplingRate", 1.0) == 1.0 and params.get("minInstancesPerNode", 1) == 1


def _by_count(rows: DataFrame, count: int, params: Mapping[str, Any]) -> bool:
    """Whether a forest is large, of two classes, and of settings that counted rows can be fitted with.

    Without a least gain there may be far more nodes than are made one by one.
    """
    settings = {**DEFAULTS["random_forest"], **params}
    if count * settings["numTrees"] <= FOREST_COUNTERS or not set(settings) <= COUNTED_FOREST:
        return False
    if settings["impurity"] != "gini" or settings["minInfoGain"] <= 0 or settings["maxBins"] > COUNTED_BINS:
        return False
    label = F.col("label")
    seen = rows.agg(F.max(label).alias("top"), F.count_if(~label.isin(0.0, 1.0)).alias("others")).first()
    return seen["top"] == 1.0 and not seen["others"]


def _numbers(parts: DataFrame, names: Sequence[str], indexers: Sequence) -> list[forest.Feature]:
    """What a tree may see of a row, in vector order: bins, yes or no, and categories."""
    kinds = {f.name: f.dataType for f in parts.schema.fields}
    found = []
    for name in names:
        # A number without bins has one value.
        whole = name.startswith(BIN_PREFIX) or not isinstance(kinds.get(name), T.NumericType)
        found.append(forest.Feature(ref(name) if whole else F.lit(0), None, False))
    for stage in indexers:
        if isinstance(stage, StringIndexerModel):
            sizes = [len(labels) + 1 for labels in stage.labelsArray]
            outs = stage.getOutputCols() if stage.isDefined("outputCols") else [stage.getOutputCol()]
            found += [forest.Feature(ref(out), size, True) for out, size in zip(outs, sizes)]
    return found


def _fit_weighted(data: DataFrame, learner):
    """Fit to one row per features and label, as heavy as there are rows of them."""
    counted = data.groupBy("features", "label").agg(F.count("*").cast("double").alias("weight"))
    counted.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        # Every tree takes a job per level: few rows are best read by few tasks.
        cores = data.sparkSession.sparkContext.defaultParallelism
        parts = max(cores, counted.count() // WEIGHTED_ROWS)
        return learner.setWeightCol("weight").fit(_spread(counted.coalesce(parts)))
    finally:
        counted.unpersist()


def _bins(rows: DataFrame, numeric: Sequence[str], max_bins: int) -> tuple[list[str], list]:
    """Names of the binned columns, and the stage that makes them, if any.

    A column of at most ``max_bins`` values is cut between all of them, others at quantiles of all rows.
    """
    kinds = {f.name: f.dataType for f in rows.schema.fields}
    cols = [c for c in numeric if isinstance(kinds.get(c), T.NumericType)]
    if not cols:
        return list(numeric), []
    values = rows.select(*(ref(c).cast("double").alias(str(i)) for i, c in enumerate(cols)))
    order = [str(i) for i in range(len(cols))]
    about = values.agg(*(F.approx_count_distinct(i, 0.02).alias(i) for i in order)).first()
    short = [i for i in order if about[i] <= 2 * max_bins]
    found = values.agg(F.lit(0).alias("none"), *(F.collect_set(i).alias(i) for i in short)).first()
    exact = {i: sorted(found[i]) for i in short if len(found[i]) <= max_bins}
    rest = [i for i in order if i not in exact]
    ranks = [k / max_bins for k in range(1, max_bins)]
    quantiles = values.approxQuantile(rest, ranks, BORDER_ERROR) if rest else []
    borders = {i: _between(exact[i]) for i in exact} | {i: sorted(set(q)) for i, q in zip(rest, quantiles)}
    named = {c: borders[i] for i, c in zip(order, cols) if borders[i]}
    if not named:
        return list(numeric), []
    made = ", ".join(f"{_bin(c, cuts)} AS {quoted(BIN_PREFIX + c)}" for c, cuts in named.items())
    return (
        [BIN_PREFIX + c if c in named else c for c in numeric],
        [SQLTransformer(statement=f"SELECT *, {made} FROM __THIS__")],
    )


def _between(values: Sequence[float]) -> list[float]:
    """Borders between neighbours; the upper one where no number lies between them."""
    pairs = [(low, low / 2 + high / 2, high) for low, high in zip(values, values[1:])]
    return [middle if low < middle < high else high for low, middle, high in pairs]


def _bin(name: str, borders: Sequence[float]) -> str:
    """The number of borders up to a value, NULL where it is missing."""
    value = f"CAST({quoted(name)} AS DOUBLE)"
    cases = " ".join(f"WHEN {value} < DOUBLE('{cut!r}') THEN {i}D" for i, cut in enumerate(borders))
    return f"CASE WHEN {value} IS NULL OR isnan({value}) THEN NULL {cases} ELSE {len(borders)}D END"


def _fit_rest(data: DataFrame, learner: OneVsRest) -> OneVsRestModel:
    """One class against the rest, both classes of two by one fit.

    The loss of the first class at some weights is that of the second at the negated ones, so its
    model is the other one negated, and rows are kept once instead of once a class and as a whole.
    """
    label = F.col("label")
    seen = data.agg(F.max(label).alias("top"), F.count_if(~label.isin(0.0, 1.0)).alias("others")).first()
    if seen["top"] != 1.0 or seen["others"]:
        return learner.fit(data)
    second = learner.getClassifier().fit(data)
    context = SparkContext._active_spark_context
    weights = _py2java(context, Vectors.dense(-second.coefficients.toArray()))
    made = context._jvm.org.apache.spark.ml.classification.LinearSVCModel(
        f"{second.uid}_negated", weights, -second.intercept
    )
    return learner._copyValues(OneVsRestModel([second._copyValues(LinearSVCModel(made)), second]))


def _fit_forest(data: DataFrame, count: int, params: Mapping[str, Any]):
    """Fit a forest, of many rows some trees at a time with seeds of their own.

    What Spark keeps per row and tree is bounded by that; the forest has all the trees asked for.
    """
    settings = {**DEFAULTS["random_forest"], **params}
    trees = settings["numTrees"]
    parts = -(-trees // max(FOREST_TREES, FOREST_COUNTERS // max(count, 1)))
    seeds = [settings["seed"], *random.Random(settings["seed"]).sample(range(2**31), parts - 1)]
    sizes = [trees // parts + (i < trees % parts) for i in range(parts)]
    fitted = [
        make_learner("random_forest", **{**settings, "numTrees": size, "seed": seed}).fit(data)
        for size, seed in zip(sizes, seeds)
    ]
    return fitted[0] if parts == 1 else _joined(fitted, trees)


def _joined(forests: Sequence[RandomForestClassificationModel], n_trees: int) -> RandomForestClassificationModel:
    """One forest of the trees of all; Python has no way to make one of given trees, so the JVM's is used."""
    first = forests[0]
    context = SparkContext._active_spark_context
    classes = context._jvm.org.apache.spark.ml.classification
    trees = [tree for forest in forests for tree in forest._java_obj.trees()]
    array = context._gateway.new_array(classes.DecisionTreeClassificationModel, len(trees))
    for i, tree in enumerate(trees):
        array[i] = tree
    java = classes.RandomForestClassificationModel(first.uid, array, first.numFeatures, first.numClasses)
    joined = first._copyValues(RandomForestClassificationModel(java))
    joined._set(numTrees=n_trees)._transfer_params_to_java()
    return joined


def _spread(data: DataFrame) -> DataFrame:
    """Training rows in at least one part per core; learners read them again and again."""
    cores = data.sparkSession.sparkContext.defaultParallelism
    return data.repartition(cores) if data.rdd.getNumPartitions() < cores else data


def _largest_category(indexers: Sequence) -> int:
    sizes = [
        len(labels) + 1
        for stage in indexers
        if isinstance(stage, StringIndexerModel)
        for labels in stage.labelsArray
    ]
    return max(sizes, default=2)


def score(model: PipelineModel, df: DataFrame, learner: str | None = None) -> DataFrame:
    """Add ``prediction`` and ``score``, the ranking score of the second class.

    Columns an earlier scoring left behind are replaced.
    """
    predicted = model.transform(df.drop(*_outputs(model, df), "score")).drop(*_texts(model))
    column = SCORE_COLUMN.get(learner or "")
    if column is None:
        column = "probability" if "probability" in predicted.columns else "rawPrediction"
    return positive_score(predicted, column)


def _texts(model: PipelineModel) -> list[str]:
    """Columns with the texts of categories and bins of numbers, which only the stages themselves need."""
    inputs = [s.getOrDefault("inputCol") for s in model.stages if isinstance(s, StringIndexerModel) and s.isDefined("inputCol")]
    inputs += [name for s in model.stages if isinstance(s, VectorAssembler) for name in s.getInputCols()]
    return [name for name in inputs if name.startswith((TEXT_PREFIX, BIN_PREFIX))]


def _outputs(model: PipelineModel, df: DataFrame) -> list[str]:
    """Columns the stages of a fitted pipeline add."""
    names: list[str] = []
    for stage in model.stages:
        if isinstance(stage, SQLTransformer):
            # Texts and slots of categories, which come after the columns given.
            names += stage.transform(df.limit(0)).columns[len(df.columns) :]
        for param in ("outputCol", "predictionCol", "probabilityCol", "rawPredictionCol"):
            if stage.hasParam(param) and stage.isDefined(param):
                names.append(stage.getOrDefault(param))
        if stage.hasParam("outputCols") and stage.isDefined("outputCols"):
            names += stage.getOrDefault("outputCols")
    return names


def feature_names(model: PipelineModel, df: DataFrame) -> list[str]:
    """Names of the vector's parts in vector order, read from column metadata."""
    prepared = PipelineModel(stages=model.stages[:-1]).transform(df.limit(0))
    field = next(f for f in prepared.schema.fields if f.name == "features")
    groups: Mapping[str, list] = field.metadata.get("ml_attr", {}).get("attrs", {})
    if not groups:
        # Scaling drops the metadata of its input, which is kept next to it.
        field = next((f for f in prepared.schema.fields if f.name == "raw_features"), field)
        groups = field.metadata.get("ml_attr", {}).get("attrs", {})
    parts = sorted((a["idx"], a["name"]) for attrs in groups.values() for a in attrs)
    return [name.removeprefix(BIN_PREFIX) for _, name in parts]


def _importances(learner_model) -> np.ndarray:
    if hasattr(learner_model, "featureImportances"):
        return learner_model.featureImportances.toArray()
    if hasattr(learner_model, "models"):
        return np.mean([np.abs(m.coefficients.toArray()) for m in learner_model.models], axis=0)
    return learner_model.coefficients.toArray()


def feature_importance(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``feature, importance, importance_pct``, highest first.

    Logistic regression: signed coefficients. Trees: impurity importance.
    One-vs-rest: mean absolute coefficient. The percentage is each feature's
    share of the summed magnitudes, 0 when that sum is 0. ``df`` supplies the
    schema only.
    """
    values = _importances(model.stages[-1])
    names = feature_names(model, df)
    if len(names) != len(values):
        raise ValueError(f"the model weighs {len(values)} features, but {len(names)} are named: {', '.join(names)}")
    total = float(np.abs(values).sum())
    rows = [
        (name, float(v), float(abs(v)) / total * 100.0 if total else 0.0)
        for name, v in zip(names, values)
    ]
    ranked = local_table(
        df.sparkSession, rows, "feature string, importance double, importance_pct double"
    )
    return ranked.orderBy(F.desc("importance"), "feature")
