"""Train, score and evaluate in one flow."""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import contextmanager
from typing import Any, NamedTuple

from pyspark import StorageLevel
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from tablecraft.operators import classify, curves, evaluate, split
from tablecraft.operators.encode import MAX_LABELS
from tablecraft.operators.features import complete_rows
from tablecraft.sources import models


class Trained(NamedTuple):
    """A fitted model and the tables that describe it on the test rows."""

    model: PipelineModel
    scored: DataFrame
    metrics: DataFrame
    confusion: DataFrame
    roc: DataFrame
    pr: DataFrame
    importance: DataFrame


@contextmanager
def _kept(df: DataFrame):
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield df
    finally:
        df.unpersist()


def _divided(df: DataFrame, numeric, categorical, label_col, key, ratio, seed) -> tuple[list[str], DataFrame, DataFrame]:
    """Names of the key, training rows and test rows, complete and with the columns needed only."""
    keys = [] if key is None else [key] if isinstance(key, str) else list(key)
    needed = list(dict.fromkeys([*keys, *numeric, *categorical, label_col]))
    rows = complete_rows(df.select(*needed), [*numeric, *categorical], label_col)
    if keys:
        return keys, *split.hash_split(rows, keys, ratio, seed)
    return keys, *split.random_split(rows, ratio, seed)


def _evaluated(model: PipelineModel, test: DataFrame, learner: str, keys: Sequence[str]) -> Trained:
    scored = classify.score(model, test, learner).select(*keys, "label", "prediction", "score")
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    return Trained(
        model,
        scored,
        evaluate.report(scored),
        evaluate.confusion(scored),
        curves.roc(scored),
        curves.pr(scored),
        classify.feature_importance(model, test),
    )


def run(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label_col: str,
    learner: str,
    key: str | Sequence[str] | None = None,
    ratio: float = split.RATIO,
    seed: int = split.SEED,
    encoding: str = "index",
    save_to: str | None = None,
    overwrite: bool = False,
    max_labels: int = MAX_LABELS,
    hash_width: int | None = None,
    **params: Any,
) -> Trained:
    """Drop incomplete rows, split, fit on training rows, score test rows, evaluate.

    With ``key`` the split depends on the key alone; without it Spark's random
    split is used. Only the columns needed are carried along. Training rows are
    kept while fitting. ``scored`` is persisted because every table reads it:
    unpersist it when done.
    """
    keys, train, test = _divided(df, numeric, categorical, label_col, key, ratio, seed)
    with _kept(train):
        model = classify.fit(
            train, learner, numeric, categorical, encoding, max_labels=max_labels, hash_width=hash_width, **params
        )
    if save_to is not None:
        models.save(model, save_to, overwrite)
    return _evaluated(model, test, learner, keys)


def run_each(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label_col: str,
    learners: Sequence[str],
    key: str | Sequence[str] | None = None,
    ratio: float = split.RATIO,
    seed: int = split.SEED,
) -> dict[str, Trained]:
    """:func:`run` for several learners by their defaults, on rows read and divided once.

    Training and test rows are kept until all have scored them.
    """
    keys, train, test = _divided(df, numeric, categorical, label_col, key, ratio, seed)
    with _kept(train), _kept(test):
        return {
            learner: _evaluated(classify.fit(train, learner, numeric, categorical), test, learner, keys)
            for learner in learners
        }
