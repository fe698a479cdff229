"""The search for benchmark passages over tables.

The benchmark is a side input: it is cut into blocks of rows by their hash, each of a
checked number of bytes, and every block is sent to the tasks and searched in all documents.
One block, the usual case, takes one pass. Of more blocks, one at a time is at the driver and in
the workers: the documents with their findings are written before the next one is taken.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.llm.common import Workspace
from tablecraft.llm.decontaminate import Benchmark, covered, words

BLOCK_BYTES = 16 << 20

FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("starts", T.ArrayType(T.IntegerType())),
        T.StructField("ends", T.ArrayType(T.IntegerType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


@lru_cache(maxsize=1)
def _tables(block: tuple[tuple[str | None, str | None], ...]) -> Benchmark:
    """Shift tables and buckets of one block, built once per Python worker."""
    return Benchmark(block)


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> list[DataFrame]:
    """The distinct items (item_id as text, text), without NULL texts, in parts of ``block_bytes`` at the most.

    Only an item that is larger by itself makes its part larger.
    """
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    items = items.distinct()
    weight = F.octet_length("text") + F.coalesce(F.octet_length("item_id"), F.lit(0)) + 64
    size = items.select(F.sum(weight).alias("n")).first()["n"] or 0
    n = -(-size // block_bytes)
    if n <= 1:
        return [items] if n else []
    while True:
        part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
        parts = items.groupBy(part.alias("part")).agg(F.sum(weight).alias("size"), F.count("*").alias("items"))
        # Hashes spread items evenly enough for this to end after a few rounds.
        if parts.where((F.col("size") > block_bytes) & (F.col("items") > 1)).isEmpty():
            return [items.where(part == i) for i in range(n)]
        n *= 2


def _collected(block: DataFrame) -> list[tuple[str | None, str]]:
    return sorted(((r["item_id"], r["text"]) for r in block.collect()), key=lambda r: (r[0] or "", r[1]))


def _search_in(rows: DataFrame, shared: Broadcast[list[tuple[str | None, str]]]) -> DataFrame:
    """One pass: the occurrences of the shared items are added to the column ``found``."""

    @F.pandas_udf(FOUND)
    def search(texts: pd.Series, before: pd.DataFrame) -> pd.DataFrame:
        tables = _tables(tuple(shared.value))
        out = []
        for text, starts, ends, names in zip(texts, before["starts"], before["ends"], before["items"]):
            text_words = words(text)
            intervals, items = tables.search(text_words)
            out.append(
                (
                    len(text_words),
                    [*([] if starts is None else starts), *(s for s, _ in intervals)],
                    [*([] if ends is None else ends), *(e for _, e in intervals)],
                    sorted({*([] if names is None else names), *items}),
                )
            )
        return pd.DataFrame(out, columns=["n_words", "starts", "ends", "items"])

    return rows.withColumn("found", search(F.col("text"), F.col("found")))


def searched(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with a column ``found`` (n_words, starts, ends, items) of all occurrences.

    A column of that name in ``docs`` is replaced. NULL texts have no words. Items
    without words have no windows; items of a NULL id mark words but are not named.
    """
    rows = docs.withColumn("found", F.lit(None).cast(FOUND))
    context = docs.sparkSession.sparkContext
    parts = blocks(benchmark, block_bytes)
    if len(parts) <= 1:
        return _search_in(rows, context.broadcast(_collected(parts[0]) if parts else []))
    workspace = Workspace(docs.sparkSession, "passages")
    for place, part in enumerate(parts):
        shared = context.broadcast(_collected(part))
        rows = workspace.keep(_search_in(rows, shared), f"block{place}")
        shared.destroy()
        if place:
            workspace.drop(f"block{place - 1}")
    return rows


@F.pandas_udf(T.StructType().add("n_hit", T.LongType()).add("items_sha256", T.StringType()))
def _summed(starts: pd.Series, ends: pd.Series, items: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(
        {
            "n_hit": [covered(zip(s, e)) for s, e in zip(starts, ends)],
            "items_sha256": [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items],
        }
    )


def report(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): words, hit words, items found and whether any was.

    Repeated rows stay repeated; an empty benchmark hits nothing; an empty table of
    documents gives an empty table; other columns are left out.
    """
    rows = searched(docs.select("doc_id", "text"), benchmark, block_bytes).select(
        "doc_id", "found", _summed("found.starts", "found.ends", "found.items").alias("s")
    )
    return rows.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        F.col("s.n_hit").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.col("s.items_sha256").alias("items_sha256"),
        (F.col("s.n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` without any occurrence, with their columns as they are."""
    names = docs.columns
    # Numbered, as names that differ in case only could not be written.
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    kept = searched(docs.select(row.alias("row"), F.col("text")), benchmark, block_bytes)
    kept = kept.where(F.size("found.starts") == 0)
    return kept.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
