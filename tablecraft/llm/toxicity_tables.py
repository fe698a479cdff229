"""Toxicity scores over tables: trained on bounded samples, applied to every text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm import toxicity

#: About so many toxic and unlabelled texts are learned from, drawn by a hash of doc_id.
TOXIC_SAMPLE = 3000
UNLABELLED_SAMPLE = 6000
HELD_OUT = 2
THRESHOLD = 0.3
_STEPS = 1_000_000


def remainder(doc_id: Column) -> Column:
    """crc32 of the number as text, modulo 4; NULL for NULL."""
    return F.pmod(F.crc32(doc_id.cast("string")), F.lit(4))


def _drawn(doc_id: Column, salt: int, wanted: int, total: int) -> Column:
    share = min(1.0, wanted / max(total, 1))
    return F.pmod(F.xxhash64(doc_id, F.lit(salt)), F.lit(_STEPS)) < int(share * _STEPS)


def fit(
    docs: DataFrame, labels: DataFrame, toxic_sample: int = TOXIC_SAMPLE, unlabelled_sample: int = UNLABELLED_SAMPLE
) -> toxicity.Classifier:
    """A classifier from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic), without held-out rows.

    Only the confirmed toxic rows are learned as such; rows marked 0 count as any other
    text. The class prior is the share of toxic ones among the labelled rows. Rows
    without doc_id or label are not learned from. One scan of the texts brings the words
    of the samples to the driver.
    """
    known = labels.where("toxic IS NOT NULL").where(remainder(F.col("doc_id")) != HELD_OUT)
    counts = known.select(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("k")).first()
    toxic = known.where("toxic = 1").where(_drawn(F.col("doc_id"), 1, toxic_sample, counts["k"]))
    # At most about toxic_sample rows, as the share drawn is set by their number.
    confirmed = F.broadcast(toxic.select(F.col("doc_id").alias("toxic_id")).distinct())
    total = docs.count()
    rows = (
        docs.select("doc_id", "text")
        .where(F.coalesce(remainder(F.col("doc_id")) != HELD_OUT, F.lit(False)))
        .join(confirmed, F.col("doc_id") == F.col("toxic_id"), "left")
        .select(
            F.col("toxic_id").isNotNull().alias("is_toxic"),
            _drawn(F.col("doc_id"), 2, unlabelled_sample, total).alias("is_drawn"),
            "text",
        )
        .where("is_toxic OR is_drawn")
    )

    @F.pandas_udf("binary")
    def distinct(texts: pd.Series) -> pd.Series:
        return pd.Series([b" ".join(toxicity.distinct(t)) for t in texts], dtype=object)

    # In the order of their words, so that a repeated run learns the same.
    sample = sorted(
        (bytes(r["words"]), r["is_toxic"], r["is_drawn"])
        for r in rows.select("is_toxic", "is_drawn", distinct("text").alias("words")).toLocalIterator()
    )
    positive = [w.split() for w, is_toxic, _ in sample if is_toxic]
    mixed = [w.split() for w, _, is_drawn in sample if is_drawn]
    return toxicity.train(positive, mixed, counts["k"] / counts["n"] if counts["n"] else 0.0)


def score(docs: DataFrame, classifier: toxicity.Classifier, threshold: float = THRESHOLD) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score and predicted.

    NULL counts as an empty text, which has a score as well. A NULL doc_id is not held
    out. Repeated rows stay repeated; an empty table gives an empty table; other
    columns are left out and never inputs of the score.
    """
    shared = docs.sparkSession.sparkContext.broadcast(classifier)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts))

    rows = docs.select(
        "doc_id",
        F.coalesce(remainder(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
        scored("text").alias("score"),
    )
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
