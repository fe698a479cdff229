"""Dividing a table into training and test rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.functions.columns import ref, require_columns

# Default share of training rows and seed.
RATIO = 0.8
SEED = 42


def random_split(df: DataFrame, ratio: float = RATIO, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Spark's own random split; its outcome depends on the partition layout."""
    train, test = df.randomSplit([ratio, 1 - ratio], seed=seed)
    return train, test


def key_fraction(key: Sequence[str], seed: int = SEED) -> Column:
    """A number in [0, 1) that depends on the key and the seed only."""
    text = F.concat_ws(":", *[ref(k).cast("string") for k in key], F.lit(str(seed)))
    head = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return head / F.lit(float(1 << 32))


def with_split(
    df: DataFrame, key: str | Sequence[str], ratio: float = RATIO, seed: int = SEED
) -> DataFrame:
    """Add ``split`` with ``train`` or ``test``, the same for a key in every run."""
    names = [key] if isinstance(key, str) else list(key)
    require_columns(df, names)
    side = F.when(key_fraction(names, seed) < ratio, "train").otherwise("test")
    return df.withColumn("split", side)


def hash_split(
    df: DataFrame, key: str | Sequence[str], ratio: float = RATIO, seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """Split by key: no shuffle, and rows recomputed after a loss stay on their side."""
    marked = with_split(df, key, ratio, seed)
    train = marked.where(F.col("split") == "train").drop("split")
    return train, marked.where(F.col("split") == "test").drop("split")
