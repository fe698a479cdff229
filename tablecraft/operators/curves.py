"""ROC and precision-recall curves and the area under the ROC curve, exact or of bounded size.

Rows are first counted per distinct score, then accumulated from the highest
score down with bucketed running totals, so no task ever sorts the whole table.
The binned forms count rows per range of scores in one scan. Their points are points of the
exact curves, at most one per range, and the area comes with a bound of its error.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablecraft.functions.cluster import local_table
from tablecraft.functions.columns import present, ratio, require_columns
from tablecraft.functions.ordered import (
    cut_points,
    join_buckets,
    running_totals,
    with_bucket,
)


#: Ranges of scores of the binned curves.
BINS = 1_000


class Binned(NamedTuple):
    """Curves of at most one point per range of scores, and the area with its error bound."""

    roc: DataFrame
    pr: DataFrame
    auc: DataFrame


def _counted(scored: DataFrame, score_col: str, positive: float) -> tuple[DataFrame, list]:
    """Positives and negatives per distinct score, and cut points of the scores."""
    require_columns(scored, ["label"])
    require_columns(scored, [score_col], kinds=["numeric"])
    score = present(scored, score_col).cast("double").alias("threshold")
    cuts = cut_points(scored.select(score).dropna(), "threshold")
    hit = F.col("label").cast("double") == F.lit(float(positive))
    counted = (
        scored.select(score, hit.alias("hit"))
        .dropna()
        .groupBy("threshold")
        .agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    )
    return counted, cuts


def _steps(scored: DataFrame, score_col: str, positive: float) -> DataFrame:
    """Counts per distinct score with their totals down to it and over the table."""
    counted, cuts = _counted(scored, score_col, positive)
    return running_totals(counted, "threshold", ["tp", "fp"], descending=True, cuts=cuts)


def _corners(steps: DataFrame) -> DataFrame:
    """Only the steps where the direction of the ROC curve changes, and the last one.

    The following step is the next one inside the bucket or the first one of the
    next bucket that has any.
    """
    inside = Window.partitionBy("__bucket").orderBy(F.desc("threshold"))
    step = F.struct("tp", "fp")
    heads = steps.groupBy("__bucket").agg(F.max(F.struct("threshold", "tp", "fp")).alias("__head"))
    along = Window.orderBy(F.desc("__bucket"))
    heads = heads.select(
        "__bucket",
        F.lead(F.struct("__head.tp", "__head.fp")).over(along).alias("__next_bucket"),
    )
    joined = join_buckets(steps, heads, [], bounded=True)
    following = F.coalesce(F.lead(step).over(inside), F.col("__next_bucket"))
    marked = joined.withColumn("__next", following)
    turns = (F.col("__next.tp") != F.col("tp")) | (F.col("__next.fp") != F.col("fp"))
    return marked.where(F.col("__next").isNull() | turns)


def roc(
    scored: DataFrame, score_col: str = "score", positive: float = 1.0, drop_collinear: bool = False
) -> DataFrame:
    """``threshold, fpr, tpr`` per distinct score and the start (0, 0) at infinity.

    Without positives (negatives) the rate is NULL.
    """
    steps = _steps(scored, score_col, positive)
    points = (_corners(steps) if drop_collinear else steps).select(
        "threshold",
        ratio(F.col("cum_fp"), F.col("all_fp")).alias("fpr"),
        ratio(F.col("cum_tp"), F.col("all_tp")).alias("tpr"),
    )
    start = local_table(
        scored.sparkSession,
        [(float("inf"), 0.0, 0.0)],
        "threshold double, fpr double, tpr double",
    )
    return points.unionAll(start)


def pr(
    scored: DataFrame, score_col: str = "score", positive: float = 1.0, end_point: bool = False
) -> DataFrame:
    """``threshold, recall, precision`` per distinct score.

    ``end_point`` adds the conventional end (recall 0, precision 1).
    """
    points = _steps(scored, score_col, positive).select(
        "threshold",
        ratio(F.col("cum_tp"), F.col("all_tp")).alias("recall"),
        ratio(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
    )
    if not end_point:
        return points
    end = local_table(
        scored.sparkSession,
        [(None, 0.0, 1.0)],
        "threshold double, recall double, precision double",
    )
    return points.unionAll(end)


def auc(scored: DataFrame, score_col: str = "score", positive: float = 1.0) -> DataFrame:
    """One row: exact area under the ROC curve, ties counted half; NULL for one class only.

    Each bucket gives its own area and its counts; what lies above a bucket only
    adds a rectangle, so the buckets are put together from one row each.
    """
    counted, cuts = _counted(scored, score_col, positive)
    rows = with_bucket(counted, "threshold", cuts)
    inside = (
        Window.partitionBy("__bucket")
        .orderBy(F.desc("threshold"))
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    height = F.sum("tp").over(inside).cast("double") - F.col("tp").cast("double") / 2
    buckets = (
        rows.withColumn("area", F.col("fp").cast("double") * height)
        .groupBy("__bucket")
        .agg(*[F.sum(c).alias(c) for c in ("area", "tp", "fp")])
    )
    above = Window.orderBy(F.desc("__bucket")).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("tp").over(above), F.lit(0)).cast("double")
    whole = buckets.withColumn("area", F.col("area") + F.col("fp").cast("double") * offset)
    product = F.sum("tp").cast("double") * F.sum("fp").cast("double")
    return whole.agg(ratio(F.sum("area"), product).alias("auc"))


def score_bins(
    scored: DataFrame,
    score_col: str = "score",
    positive: float = 1.0,
    bins: int = BINS,
    edges: Sequence[float] | None = None,
) -> DataFrame:
    """``threshold, tp, fp``: positives and negatives per range of scores, and its lowest score.

    Ranges lie between ``edges``, or hold about equally many rows of an estimate; a score
    that many rows have is never split. Counts of different rows can be added up.
    """
    require_columns(scored, ["label"])
    require_columns(scored, [score_col], kinds=["numeric"])
    hit = F.col("label").cast("double") == F.lit(float(positive))
    rows = scored.select(present(scored, score_col).cast("double").alias("threshold"), hit.alias("hit")).dropna()
    cuts = sorted(set(map(float, edges))) if edges is not None else cut_points(rows, "threshold", bins)
    return (
        with_bucket(rows, "threshold", cuts)
        .groupBy("__bucket")
        .agg(
            F.min("threshold").alias("threshold"),
            F.count_if("hit").alias("tp"),
            F.count_if(~F.col("hit")).alias("fp"),
        )
        .drop("__bucket")
    )


def binned(
    scored: DataFrame,
    score_col: str = "score",
    positive: float = 1.0,
    bins: int = BINS,
    edges: Sequence[float] | None = None,
) -> Binned:
    """ROC, precision-recall curve and area from one scan of the counts of :func:`score_bins`.

    Every point is one of the exact curve, at the lowest score of its range. The area
    counts the pairs inside a range half; ``error`` is half their share, and the exact
    area differs by that at most.
    """
    counted = score_bins(scored, score_col, positive, bins, edges)
    # One row per range is held, so the three tables read the rows once.
    held = local_table(scored.sparkSession, [tuple(r) for r in counted.collect()], counted.schema)
    down = Window.orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy()
    steps = held.select(
        "threshold", "tp", "fp",
        *[F.sum(c).over(down).alias(f"cum_{c}") for c in ("tp", "fp")],
        *[F.sum(c).over(everything).alias(f"all_{c}") for c in ("tp", "fp")],
    )
    start = local_table(scored.sparkSession, [(float("inf"), 0.0, 0.0)], "threshold double, fpr double, tpr double")
    roc_points = steps.select(
        "threshold",
        ratio(F.col("cum_fp"), F.col("all_fp")).alias("fpr"),
        ratio(F.col("cum_tp"), F.col("all_tp")).alias("tpr"),
    ).unionAll(start)
    pr_points = steps.select(
        "threshold",
        ratio(F.col("cum_tp"), F.col("all_tp")).alias("recall"),
        ratio(F.col("cum_tp"), F.col("cum_tp") + F.col("cum_fp")).alias("precision"),
    )
    fp, tp = F.col("fp").cast("double"), F.col("tp").cast("double")
    product = F.sum("tp").cast("double") * F.sum("fp").cast("double")
    area = steps.agg(
        ratio(F.sum(fp * (F.col("cum_tp").cast("double") - tp / 2)), product).alias("auc"),
        ratio(F.sum(fp * tp / 2), product).alias("error"),
    )
    return Binned(roc_points, pr_points, area)
