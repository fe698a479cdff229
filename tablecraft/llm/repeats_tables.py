"""Removal of repeated byte strings over tables, by ranks of growing strings at runs of places.

This is not prefix doubling with a row per place: ranks are hashes of the strings themselves, not pairs of
earlier ranks, and lengths do not double. Places whose strings so far are alike share a rank; each round ranks longer strings at
the places still open, until a string is unique, and its place closed, or as long as the
threshold, and its place repeated. Places that start next to each other and have the same
anchor travel as one row (``repeats``), so that a round sorts runs and not bytes:

* round 0 ranks the string at each run's anchor, 128 bytes;
* the next rounds cut the runs at fixed offsets from their anchor and rank the string
  that all places of a piece share, 337 and 393 bytes, and at last single places, 400.

In every round a piece has a pair of ranks: of the string its places share, and of the
whole string they cover. If the shared one is unique, none of the places is repeated. If
the whole one is not, all of them are. Pieces in between go on. Of pieces with one whole
string a single one goes on as a witness for others, so a group of copies costs one row.

Equal texts have equal results, so texts are made distinct first, in a table bucketed by
key, which later rounds read without another shuffle of texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecraft.llm import repeats
from tablecraft.llm.common import Workspace

RANKS = ["a1", "a2", "b1", "b2"]
PIECE = "key binary, anchor int, low int, high int, open boolean, weight int"
ROW = f"{PIECE}, a1 long, a2 long, b1 long, b2 long"
KINDS = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.int32()] + [pa.int64()] * 4
NAMES = ["key", "anchor", "low", "high", "open", "weight", *RANKS]
BATCH = 20_000


def _key(text: Column) -> Column:
    """16 bytes that stand for a text; NULL is the empty text."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield _batch(held)
            held = []
    yield _batch(held)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS)], names=NAMES)


def _first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for batch in batches:
            for key, data, copies in zip(*(batch.column(c).to_pylist() for c in ("key", "data", "copies"))):
                for node, gram in repeats.runs(data):
                    yield (key, *node, True, copies, gram, 0, *repeats.whole(data, node))

    return _batches(rows())


def _next_round(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                for key, data, pieces in zip(*(batch.column(c).to_pylist() for c in ("key", "data", "pieces"))):
                    for p in pieces:
                        for node in repeats.blocks(repeats.Node(p["anchor"], p["low"], p["high"]), size):
                            shared = repeats.common(data, node, size)
                            yield (key, *node, p["open"], p["weight"], *shared, *repeats.whole(data, node))

        return _batches(rows())

    return run


def _decide(rows: DataFrame, workspace: Workspace, step: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(places found to be repeated, pieces that go on)."""
    shared = ["a1", "a2"]
    alike = (
        rows.groupBy(*shared)
        .agg(F.sum("weight").alias("n"), F.max("open").alias("any_open"))
        .where("n > 1 AND any_open")
        .select(*shared)
    )
    alike = workspace.keep(alike, f"alike-{step}")
    left = workspace.keep(rows.join(alike, shared, "left_semi"), f"left-{step}")
    # Rows of one whole string have the same anchor in it, and so the same range of offsets.
    whole = ["b1", "b2", "low", "high"]
    classes = workspace.keep(
        left.groupBy(*whole, *shared).agg(
            F.sum("weight").alias("n"),
            F.max("open").alias("any_open"),
            F.min(F.struct("key", "anchor")).alias("one"),
        ),
        f"classes-{step}",
    )
    found = workspace.keep(
        left.where("open")
        .join(classes.where("n > 1").select(*whole), whole, "left_semi")
        .select("key", (F.col("anchor") - F.col("high")).alias("first"), (F.col("anchor") - F.col("low")).alias("last")),
        f"found-{step}",
    )
    if last:
        return found, None
    still = F.col("any_open") & (F.col("n") == 1)
    # Written first, so that the join stands alone and Spark can split a shared string of very many pieces.
    several = workspace.keep(
        classes.groupBy(*shared)
        .agg(F.count("*").alias("strings"), F.max(still).alias("any_still"))
        .where("strings > 1 AND any_still")
        .select(*shared),
        f"several-{step}",
    )
    on = classes.join(several, shared, "left_semi").select(
        "one.key", "one.anchor", "low", "high", still.alias("open"), F.lit(1).alias("weight")
    )
    return found, workspace.keep(on, f"on-{step}")


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    for batch in batches:
        rows = []
        for key, data, places in zip(*(batch.column(c).to_pylist() for c in ("key", "data", "places"))):
            spans = repeats.merged((p["first"], p["last"] + repeats.LENGTH) for p in places or [])
            kept = repeats.without(data, spans)
            rows.append((key, len(data), len(data) - len(kept), len(spans), repeats.digest(kept), kept))
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=names)


def _distinct_texts(docs: DataFrame, workspace: Workspace) -> tuple[DataFrame, str]:
    """(key, data, copies): every text once, as bytes, bucketed by key; copies is 2 for more than one row."""
    spark = docs.sparkSession
    name = f"llm_texts_{uuid.uuid4().hex}"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(_key(F.col("text")).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.groupBy("key").agg(F.first("text").alias("text"), F.count("*").alias("n"))
    (
        texts.select("key", F.col("text").cast("binary").alias("data"), F.least(F.col("n"), F.lit(2)).cast("int").alias("copies"))
        .repartition(tasks, "key")
        .write.bucketBy(tasks, "key")
        .option("path", workspace.path("texts"))
        .saveAsTable(name)
    )
    return spark.table(name), name


def cleaned(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of doc_id and key, results by key with the bytes that are kept)."""
    spark = docs.sparkSession
    workspace = Workspace(spark, "repeats")
    texts, name = _distinct_texts(docs, workspace)
    rows = workspace.keep(texts.mapInArrow(_first_round, ROW), "rows-0")
    found, on = _decide(rows, workspace, 0, last=False)
    places = [found]
    for step, size in enumerate(repeats.BLOCKS, start=1):
        workspace.drop(f"rows-{step - 1}")
        pieces = on.groupBy("key").agg(F.collect_list(F.struct("anchor", "low", "high", "open", "weight")).alias("pieces"))
        rows = workspace.keep(
            texts.select("key", "data").join(pieces, "key").mapInArrow(_next_round(size), ROW), f"rows-{step}"
        )
        found, on = _decide(rows, workspace, step, last=size == 1)
        places.append(found)
    all_places = places[0]
    for found in places[1:]:
        all_places = all_places.unionAll(found)
    by_key = all_places.groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("places"))
    results = workspace.keep(
        texts.select("key", "data").join(by_key, "key", "left").mapInArrow(
            _removed, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
        ),
        "results",
    )
    spark.sql(f"DROP TABLE {name}")
    workspace.drop("texts")
    return docs.select("doc_id", _key(F.col("text")).alias("key")), results


def remove(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): bytes, removed bytes, removed runs and the digest of the rest.

    A byte goes if it lies in a string of 400 bytes that also starts elsewhere in any
    row, as judged on the input. NULL counts as an empty text. A text that several rows
    have is repeated as a whole if it has 400 bytes. An empty table gives an empty
    table; other columns are left out. Texts and strings are told apart by hashes of
    128 bits.
    """
    rows, results = cleaned(docs)
    return rows.join(results.drop("kept"), "key").drop("key")
