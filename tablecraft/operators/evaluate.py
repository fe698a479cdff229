"""Metrics of any scored table with ``label`` and ``prediction``.

Everything follows from one grouped count of (label, prediction), whose size is
the square of the number of classes, so a table is scored and read once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import dtype_of, ratio, ref, require_columns
from tablecraft.operators import curves


def positive_score(df: DataFrame, col: str, out: str = "score") -> DataFrame:
    """Add the second element of a probability or raw-score vector as a double."""
    require_columns(df, [col])
    column = ref(col)
    if dtype_of(df, col).simpleString() == "vector":
        column = vector_to_array(column)
    return df.withColumn(out, F.try_element_at(column, F.lit(2)).cast("double"))


def confusion(scored: DataFrame) -> DataFrame:
    """``label, prediction, count``, one row per combination that occurs."""
    return scored.groupBy(
        F.col("label").cast("double").alias("label"),
        F.col("prediction").cast("double").alias("prediction"),
    ).agg(F.count(F.lit(1)).alias("count"))


def confusion_wide(scored: DataFrame, classes: Sequence[float] | None = None) -> DataFrame:
    """One row per label and a column ``predicted_<class>`` with zeros filled in.

    ``classes`` names the columns; without it they are the predictions that occur, listed
    at the driver, so give it (or use :func:`confusion`) where there may be very many.
    Rows without a prediction are then counted in ``predicted_none`` if there are any.
    """
    cells = confusion(scored)
    if classes is None:
        values = [r["prediction"] for r in cells.select("prediction").distinct().collect()]
        classes, missing = sorted(v for v in values if v is not None), None in values
    else:
        missing = False

    def counted(condition: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("count"))), F.lit(0)).alias(name)

    columns = [counted(F.col("prediction") == float(c), f"predicted_{_written(float(c))}") for c in classes]
    if missing:
        columns.append(counted(F.col("prediction").isNull(), "predicted_none"))
    if not columns:
        return cells.select("label").distinct()
    return cells.groupBy("label").agg(*columns)


def _written(number: float) -> str:
    """The shortest text that reads as the same number, whole numbers without a point."""
    return str(int(number)) if number.is_integer() else repr(number)


def _classes(cells: DataFrame) -> DataFrame:
    hit = F.when(F.col("label") == F.col("prediction"), F.col("count")).otherwise(F.lit(0))
    none = F.lit(0).cast("long")
    views = F.array(
        F.struct(
            F.col("label").alias("class"),
            F.col("count").alias("support"),
            none.alias("predicted"),
            hit.alias("true_positive"),
        ),
        F.struct(
            F.col("prediction").alias("class"),
            none.alias("support"),
            F.col("count").alias("predicted"),
            none.alias("true_positive"),
        ),
    )
    per_class = (
        cells.select(F.inline(views))
        .groupBy("class")
        .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "true_positive")])
    )
    precision = ratio(F.col("true_positive"), F.col("predicted"), 0.0)
    recall = ratio(F.col("true_positive"), F.col("support"), 0.0)
    scored = per_class.withColumns({"precision": precision, "recall": recall})
    harmonic = 2 * F.col("precision") * F.col("recall")
    return scored.withColumn("f1", ratio(harmonic, F.col("precision") + F.col("recall"), 0.0))


def per_class_metrics(scored: DataFrame) -> DataFrame:
    """``class, support, predicted, true_positive, precision, recall, f1``."""
    return _classes(confusion(scored))


def _weighted(name: str) -> Column:
    return ratio(F.sum(F.col(name) * F.col("support")), F.sum("support"))


def metrics(scored: DataFrame, positive: float = 1.0) -> DataFrame:
    """``metric, value``: accuracy, weighted F1, precision and recall, and those of one class."""
    mine = F.col("class") == float(positive)
    wide = _classes(confusion(scored)).agg(
        ratio(F.sum("true_positive"), F.sum("support")).alias("accuracy"),
        _weighted("f1").alias("f1"),
        _weighted("precision").alias("weighted_precision"),
        _weighted("recall").alias("weighted_recall"),
        F.coalesce(F.max(F.when(mine, F.col("precision"))), F.lit(0.0)).alias("precision"),
        F.coalesce(F.max(F.when(mine, F.col("recall"))), F.lit(0.0)).alias("recall"),
    )
    return wide.unpivot([], wide.columns, "metric", "value")


def report(scored: DataFrame, score_col: str = "score", positive: float = 1.0) -> DataFrame:
    """:func:`metrics` and the exact area under the ROC curve."""
    area = curves.auc(scored, score_col, positive).select(
        F.lit("auc").alias("metric"), F.col("auc").alias("value")
    )
    return metrics(scored, positive).unionAll(area)


def compare(models: Mapping[str, DataFrame], score_col: str = "score", positive: float = 1.0) -> DataFrame:
    """``model, metric, value`` for several scored tables."""
    reports = [
        report(scored, score_col, positive).select(F.lit(name).alias("model"), "metric", "value")
        for name, scored in models.items()
    ]
    return reduce(DataFrame.unionAll, reports)
