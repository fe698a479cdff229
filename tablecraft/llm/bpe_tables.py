"""Byte-level BPE over tables. The driver reads the vocabulary and sends it to the tasks as bytes."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
import public_tokenizers
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecraft.llm import bpe

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: A vocabulary is a fixed file; a larger one is refused, as it goes to every task.
MAX_VOCABULARY_BYTES = 64 << 20


@lru_cache(maxsize=1)
def _coder(ranks: bytes, pattern: str) -> bpe.Text:
    """One set of tables per Python worker."""
    return bpe.Text(bpe.parse_ranks(ranks), pattern)


def vocabulary(spark: SparkSession, path: str | None = None) -> Broadcast:
    """The bytes of a file of base64 tokens and ranks."""
    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        ranks = file.read(MAX_VOCABULARY_BYTES + 1)
    if len(ranks) > MAX_VOCABULARY_BYTES:
        raise ValueError(f"a vocabulary of over {MAX_VOCABULARY_BYTES} bytes")
    return spark.sparkContext.broadcast(ranks)


def encode(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per row: doc_id, n_tokens and ids, an array of ints. NULL counts as an empty text."""
    ranks = vocabulary(docs.sparkSession, path)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        coder = _coder(ranks.value, pattern)
        return pd.Series([coder.encode(t or "") for t in texts], dtype=object)

    rows = docs.select("doc_id", run(F.col("text")).alias("ids"))
    ids = F.when(F.col("ids") == "", F.array().cast("array<int>")).otherwise(
        F.split("ids", ",").cast("array<int>")
    )
    return rows.select("doc_id", ids.alias("ids")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids"
    )


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """Per row: doc_id and the bytes that ``ids`` stand for; NULL gives NULL."""
    ranks = vocabulary(encoded.sparkSession, path)

    @F.pandas_udf("binary")
    def run(ids: pd.Series) -> pd.Series:
        coder = _coder(ranks.value, public_tokenizers.PATTERN)
        return pd.Series([x if x is None else coder.decode(x) for x in ids], dtype=object)

    return encoded.select("doc_id", run(F.array_join("ids", ",")).alias("bytes"))


def digests(docs: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Per row (doc_id, text): number of tokens, SHA-256 of the ids and of the decoded bytes.

    Encodes and decodes each whole text and hashes where the bytes are made, so that
    what leaves Python is small. NULL counts as an empty text. Repeated rows stay
    repeated, an empty table gives an empty table, other columns are left out.
    """
    ranks = vocabulary(docs.sparkSession, path)

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pd.Series) -> pd.DataFrame:
        coder = _coder(ranks.value, pattern)
        rows = []
        for text in texts:
            ids = coder.encode(text or "")
            decoded = coder.decode(ids)
            rows.append(
                (
                    ids.count(",") + 1 if ids else 0,
                    hashlib.sha256(ids.encode()).hexdigest(),
                    hashlib.sha256(decoded).hexdigest(),
                )
            )
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", run(F.col("text")).alias("c")).select("doc_id", "c.*")
