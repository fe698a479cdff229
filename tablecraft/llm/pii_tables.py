"""The personal-data search over tables."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.llm import pii


FOUND = T.StructType(
    [
        *(T.StructField(f"n_{kind}", T.LongType()) for kind in pii.BASE_KINDS),
        T.StructField("base_sha256", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
    ]
)


@F.pandas_udf(FOUND)
def _found(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        found = pii.spans(text or "")
        shown = [f"{k}:{s}:{e}" for k, s, e, _ in found]
        base = [x for x, (k, *_) in zip(shown, found) if k in pii.BASE_KINDS]
        kinds = [k for k, *_ in found]
        rows.append(
            (
                *(kinds.count(k) for k in pii.BASE_KINDS),
                hashlib.sha256(",".join(base).encode()).hexdigest(),
                ",".join(shown),
                [x[3] for x in found],
            )
        )
    return pd.DataFrame(rows, columns=FOUND.names)


@F.pandas_udf(T.StringType())
def _masked(texts: pd.Series) -> pd.Series:
    return pd.Series([t if t is None else pii.mask(t, pii.spans(t)) for t in texts], dtype=object)


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per row (doc_id, text): numbers of base spans, their digest, all spans and their scores.

    NULL counts as an empty text: no spans, the digest of nothing. Repeated rows
    stay repeated; an empty table gives an empty table; other columns are left out.
    """
    rows = docs.select("doc_id", _found(F.col(text)).alias("f"))
    return rows.select("doc_id", "f.*")


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """All rows and columns, with each span of ``text`` replaced by its kind; NULL stays NULL."""
    return docs.withColumn(text, _masked(F.col(text)))
