"""Saving and loading fitted pipelines."""

from __future__ import annotations

from pyspark.ml import PipelineModel


def save(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    """Write the whole fitted pipeline: encoders, scaler and learner together."""
    writer = model.write()
    (writer.overwrite() if overwrite else writer).save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
