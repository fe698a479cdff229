"""Feature vectors and the stages that build a modelling table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    OneHotEncoder,
    StandardScaler,
    VectorAssembler,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import ref, require_columns
from tablecraft.operators import encode


#: Columns with the texts that category indexes look up.
TEXT_PREFIX = "__text_"


def assemble(
    df: DataFrame, cols: Sequence[str], output: str = "features", on_missing: str = "skip"
) -> DataFrame:
    """Add a vector of numeric columns; an older column of that name is replaced.

    ``on_missing``: ``skip`` drops rows with missing parts, ``error`` fails on
    them, ``keep`` puts NaN in the vector.
    """
    names, _ = require_columns(df, cols, kinds=["numeric", "boolean"])
    if output in names:
        raise ValueError(f"{output} is both an input and the output")
    assembler = VectorAssembler(inputCols=names, outputCol=output, handleInvalid=on_missing)
    return assembler.transform(df.drop(output))


def with_label(df: DataFrame, label_col: str) -> DataFrame:
    """Rename the target to ``label`` and make it a double."""
    require_columns(df, [label_col], kinds=["numeric", "boolean"])
    if label_col != "label" and "label" in df.columns:
        raise ValueError("the table already has another column named label")
    return df.withColumnsRenamed({label_col: "label"}).withColumn("label", F.col("label").cast("double"))


def _index_names(categorical: Sequence[str], encoding: str) -> list[str]:
    suffix = "index" if encoding == "onehot" else "encoded"
    return [f"{c}_{suffix}" for c in categorical]


def fit_indexers(
    df: DataFrame,
    categorical: Sequence[str],
    encoding: str = "index",
    max_labels: int = encode.MAX_LABELS,
    hash_width: int | None = None,
) -> list:
    """Stages that index categories of any type, fitted on ``df``.

    The category lists are kept at the driver and in the model, so the caller says with
    ``max_labels`` how many there may be in all. With ``hash_width`` there is no list:
    categories are hashed to that many slots, and any number of them will do.
    """
    if not categorical:
        return []
    if hash_width is not None:
        names = _index_names(categorical, encoding)
        hashed: list = [encode.hash_stage(df, categorical, names, hash_width)]
        if encoding == "onehot":
            hashed.append(encode.slot_encoder(df.sparkSession, names, [f"{c}_ohe" for c in categorical], hash_width))
        return hashed
    texts = [f"{TEXT_PREFIX}{i}" for i in range(len(categorical))]
    fitted = encode.fit_labels(df, categorical, texts, _index_names(categorical, encoding), max_labels)
    if fitted is None:
        raise ValueError(f"more than {max_labels} categories; raise max_labels to list them, or give hash_width")
    return [encode.text_stage(df, categorical, texts), *fitted]


def stages(
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    encoding: str = "index",
    scale: bool = False,
    on_missing: str = "skip",
    indexers: Sequence = (),
    hash_width: int | None = None,
) -> list:
    """Unfitted stages ending in the column ``features``.

    ``encoding``: ``index`` puts the label index of a category in the vector,
    ``onehot`` one 0/1 slot per known category (unseen ones are all zeros).
    ``scale`` standardises the whole vector. ``indexers`` come from
    :func:`fit_indexers` for the same categorical columns and ``hash_width``.
    """
    if encoding not in ("index", "onehot"):
        raise ValueError("encoding must be 'index' or 'onehot'")
    built: list = []
    inputs = list(numeric)
    if categorical:
        onehot = encoding == "onehot"
        indexed = _index_names(categorical, encoding)
        built += indexers
        if onehot:
            wide = [f"{c}_ohe" for c in categorical]
            if hash_width is None:
                built.append(OneHotEncoder(inputCols=indexed, outputCols=wide, dropLast=True))
            indexed = wide
        inputs += indexed
    vector = "raw_features" if scale else "features"
    built.append(VectorAssembler(inputCols=inputs, outputCol=vector, handleInvalid=on_missing))
    if scale:
        built.append(
            StandardScaler(inputCol=vector, outputCol="features", withMean=True, withStd=True)
        )
    return built


def pipeline(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    encoding: str = "index",
    scale: bool = False,
    on_missing: str = "skip",
    max_labels: int = encode.MAX_LABELS,
    hash_width: int | None = None,
) -> Pipeline:
    """The stages of :func:`stages` as one pipeline, to be fitted on training rows.

    Categories are listed here, from ``df``, unless ``hash_width`` is given.
    """
    require_columns(df, [*numeric, *categorical])
    indexers = fit_indexers(df, categorical, encoding, max_labels, hash_width)
    return Pipeline(stages=stages(numeric, categorical, encoding, scale, on_missing, indexers, hash_width))


def complete_rows(df: DataFrame, columns: Sequence[str], label_col: str) -> DataFrame:
    """Label the table and drop rows with a missing feature or label only."""
    names, _ = require_columns(df, columns)
    labelled = with_label(df, label_col)
    return labelled.na.drop(subset=[*names, "label"])


def build(
    df: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    label_col: str = "label",
    encoding: str = "index",
    scale: bool = False,
    on_missing: str = "skip",
    max_labels: int = encode.MAX_LABELS,
    hash_width: int | None = None,
) -> tuple[DataFrame, PipelineModel]:
    """The modelling table (``label`` and ``features`` added) and its fitted stages.

    ``skip`` drops rows with a missing feature or label; ``keep`` retains them
    with NaN parts, for learners that accept NaN. At most ``max_labels`` categories are
    listed; with ``hash_width`` any number is hashed to that many slots.
    """
    require_columns(df, [*numeric, *categorical])
    rows = (
        with_label(df, label_col)
        if on_missing == "keep"
        else complete_rows(df, [*numeric, *categorical], label_col)
    )
    indexers = fit_indexers(rows, categorical, encoding, max_labels, hash_width)
    built = stages(numeric, categorical, encoding, scale, on_missing, indexers, hash_width)
    fitted = Pipeline(stages=built).fit(rows)
    columns = [*rows.columns, "features"]
    return fitted.transform(rows).select(*map(ref, columns)), fitted
