"""Hard negatives by exact search in Hilbert-ordered blocks with zone maps.

1. Vectors are ordered along a Hilbert curve through their most varying dimensions and
   cut into blocks of BLOCK_ROWS. A block is one row of a Parquet table: its zone map
   (least and greatest value of every dimension, the labels in it) and its vectors.
2. Queries (an anchor, whether labels must agree, a window of scores, how many) are
   taken in batches of BATCH anchors, each broadcast.
3. For a batch only the columns of the zone maps are read first. Bounds by interval
   arithmetic say which blocks may hold scores inside the window. Those with the highest
   bounds are read, and their scores give each query a floor: its last place so far.
4. The zone maps are asked again with the floors. The blocks left are read; a task keeps
   the first rows of each query over its blocks, and tasks are combined by query.

The result is exact: a block is left out only if none of its rows can be in the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecraft.llm import hilbert
from tablecraft.llm.common import Workspace

#: Rows of a block.
BLOCK_ROWS = 512
#: Blocks written by one task.
TASK_BLOCKS = 32
#: Anchors whose vectors are broadcast at once.
BATCH = 4096
#: Blocks read for the floor of a query.
FIRST_BLOCKS = 2
#: Blocks whose bounds are computed at once.
ZONES = 64
#: Dimensions and bits per dimension of the curve.
CURVE_DIMS, CURVE_BITS = 16, 4

#: Values of the task: anchors, positives, negatives, and the window of negatives in percent of the positive's score.
ANCHOR_STEP, RELABEL_STEP, LABELS = 50, 7, 10
POSITIVES, NEGATIVES, LEAST_SHARE, MOST_SHARE = 5, 3, 50, 95

_WIDE = 2**62
#: Stands for a NULL id inside.
NO_ID = 2**63 - 1


def whole(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, components as floor(256 * x).

    Left out are rows with a NULL label or vector and those with a component that is
    NULL or not finite, or without any component. An id divisible by 7 has the label
    (label + 1) % 10.
    """
    numbers = F.transform("embedding", lambda x: x.cast("double"))
    # NaN is above all other numbers.
    good = F.forall("numbers", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
    label = F.when(F.col("vec_id") % RELABEL_STEP == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return (
        embeddings.select("vec_id", label.cast("long").alias("label"), numbers.alias("numbers"))
        .where(F.col("label").isNotNull() & (F.size("numbers") > 0) & F.coalesce(good, F.lit(False)))
        .select("vec_id", "label", F.transform("numbers", lambda x: F.floor(x * 256)).alias("v"))
    )


def _matrix(vectors: list, dims: int) -> np.ndarray:
    """Vectors as rows; a shorter one is filled up with zeros."""
    out = np.zeros((len(vectors), dims), np.int64)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _ragged(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) == len(column) * dims:
        return flat.reshape(len(column), dims)
    return _matrix(column.to_pylist(), dims)


BLOCK = "block long, least array<long>, most array<long>, labels array<long>, ids array<long>, tags array<long>, v array<long>"


def blocks(rows: DataFrame, workspace: Workspace) -> tuple[DataFrame, int]:
    """The blocks of ``rows`` (vec_id, label, v) as a written table, and the number of dimensions."""
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    dims = size["dims"] or 1
    spread: list = []
    for start in range(0, dims, 256):
        own = range(start, min(start + 256, dims))
        values = {k: F.coalesce(F.get("v", F.lit(k)), F.lit(0)).cast("double") for k in own}
        row = rows.agg(
            *[f(values[k]).alias(f"{name}{k}") for k in own for name, f in (("v", F.var_pop), ("a", F.min), ("b", F.max))]
        ).first()
        spread += [(row[f"v{k}"] or 0.0, k, row[f"a{k}"] or 0.0, row[f"b{k}"] or 0.0) for k in own]
    curve = sorted(spread, reverse=True)[:CURVE_DIMS]

    @F.pandas_udf(T.LongType())
    def place(vectors: pd.Series) -> pd.Series:
        matrix = _matrix(list(vectors), dims)
        cells = np.zeros((len(matrix), len(curve)), np.uint64)
        for k, (_, d, low, high) in enumerate(curve):
            share = (matrix[:, d] - low) / (high - low) if high > low else np.zeros(len(matrix))
            cells[:, k] = np.clip(share * 2**CURVE_BITS, 0, 2**CURVE_BITS - 1).astype(np.uint64)
        along = hilbert.places(cells, CURVE_BITS)
        # As signed numbers of the same order.
        return pd.Series((along ^ np.uint64(1 << 63)).view(np.int64))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            matrix = _ragged(batch.column("v"), dims)
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            tags = batch.column("label").to_numpy(zero_copy_only=False)
            first = batch.column("number")[0].as_py()
            out = []
            for at in range(0, len(matrix), BLOCK_ROWS):
                part = slice(at, at + BLOCK_ROWS)
                m = matrix[part]
                out.append((first + at, m.min(0), m.max(0), np.unique(tags[part]), ids[part], tags[part], m.ravel()))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), *[pa.array(list(c), pa.list_(pa.int64())) for c in columns[1:]]],
                names=["block", "least", "most", "labels", "ids", "tags", "v"],
            )

    tasks = max(1, -(-size["n"] // (BLOCK_ROWS * TASK_BLOCKS)))
    ordered = (
        rows.withColumn("place", place("v"))
        .repartitionByRange(tasks, "place", "vec_id")
        .sortWithinPartitions("place", "vec_id")
        .select("vec_id", "label", "v", F.monotonically_increasing_id().alias("number"))
    )
    return workspace.keep(ordered.mapInArrow(cut, BLOCK), "blocks"), dims


@dataclass
class Queries:
    """Searches of a batch, one per entry; ``anchor`` is a place in ``vectors`` and ``ids``."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    anchor: np.ndarray
    same: bool
    low: np.ndarray
    high: np.ndarray
    n: int

    def open(self, least: np.ndarray, most: np.ndarray, labels: list, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(may hold a result, upper bound) by query and block, by the zone maps of blocks."""
        lower, upper = hilbert.bounds(self.vectors, least, most)
        has = np.array([np.isin(self.labels, own) if self.same else (len(own) > 1) | ~np.isin(self.labels, own)
                        for own in labels]).T
        lower, upper, has = lower[self.anchor], upper[self.anchor], has[self.anchor]
        return has & (upper >= low[:, None]) & (lower <= self.high[:, None]), upper

    def found(self, which: np.ndarray, low: np.ndarray, ids: np.ndarray, tags: np.ndarray, v: np.ndarray):
        """(query, score, id) of the first results of the queries ``which`` among the rows of a block."""
        anchors, place = np.unique(self.anchor[which], return_inverse=True)
        s = hilbert.scores(self.vectors[anchors], v)[place]
        fits = (s >= low[which, None]) & (s <= self.high[which, None])
        agree = tags[None, :] == self.labels[self.anchor[which], None]
        fits &= agree if self.same else ~agree
        x, y = np.nonzero(fits)
        query, score, ident = which[x], s[x, y], ids[y]
        keep = hilbert.first_of(query, score, ident, self.n)
        return query[keep], score[keep], ident[keep]


class _Tops:
    """The first ``n`` results per query over what has been added."""

    def __init__(self, n: int):
        self.n, self.parts, self.held = n, [], 0

    def add(self, part: tuple) -> None:
        self.parts.append(part)
        self.held += len(part[0])
        if self.held > 1 << 20:
            self.parts = [self.result()]
            self.held = len(self.parts[0][0])

    def result(self) -> tuple:
        q, s, i = (np.concatenate(c) for c in zip(*self.parts))
        keep = hilbert.first_of(q, s, i, self.n)
        return q[keep], s[keep], i[keep]


def _zones(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple]:
    """(block, least, most, labels) of ZONES blocks at a time."""
    for whole_batch in batches:
        for at in range(0, whole_batch.num_rows, ZONES):
            batch = whole_batch.slice(at, ZONES)
            yield (
                batch.column("block").to_numpy(zero_copy_only=False),
                _ragged(batch.column("least"), dims),
                _ragged(batch.column("most"), dims),
                [np.array(own) for own in batch.column("labels").to_pylist()],
            )


def _search(table: DataFrame, dims: int, queries: Queries) -> DataFrame:
    """(query, score, id) of the first results of all ``queries`` over the blocks of ``table``."""
    spark = table.sparkSession
    shared = spark.sparkContext.broadcast(queries)
    zones = table.select("block", "least", "most", "labels")
    if not len(queries.anchor):
        return spark.createDataFrame([], "query long, score long, id long")

    def promising(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of the blocks of a task, those with the highest bounds per query."""
        q, tops = shared.value, None
        for block, least, most, labels in _zones(batches, dims):
            may, upper = q.open(least, most, labels, q.low)
            x, y = np.nonzero(may)
            tops = tops or _Tops(FIRST_BLOCKS)
            tops.add((x, np.minimum(upper[x, y], q.high[x]), block[y]))
        if tops:
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in tops.result()], names=["query", "bound", "block"])

    best = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    first = (
        zones.mapInArrow(promising, "query long, bound long, block long")
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= FIRST_BLOCKS)
        .groupBy("block")
        .agg(F.collect_list("query").alias("queries"))
    )
    floors = np.array(queries.low)
    # One number per query of the batch comes back, whatever the size of the table.
    last = (
        _read(table, first, dims, shared, queries.low, queries.n)
        .groupBy("query")
        .agg(F.count("*").alias("n"), F.sort_array(F.collect_list("score"), False).alias("scores"))
        .where(F.col("n") >= queries.n)
        .select("query", F.get("scores", F.lit(queries.n - 1)).alias("floor"))
        .toPandas()
    )
    floors[last["query"].to_numpy()] = last["floor"].to_numpy()

    def needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        for block, least, most, labels in _zones(batches, dims):
            may, _ = q.open(least, most, labels, floors)
            lists = [np.flatnonzero(may[:, k]) for k in range(len(block))]
            use = [k for k, own in enumerate(lists) if len(own)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[use], pa.int64()), pa.array([lists[k] for k in use], pa.list_(pa.int64()))],
                names=["block", "queries"],
            )

    wanted = zones.mapInArrow(needed, "block long, queries array<long>")
    found = _read(table, wanted, dims, shared, floors, queries.n)
    place = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= queries.n)


def _read(table: DataFrame, wanted: DataFrame, dims: int, shared, low: np.ndarray, n: int) -> DataFrame:
    """(query, score, id): the first ``n`` results of each query in each task that reads ``wanted`` blocks."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, tops = shared.value, _Tops(n)
        for batch in batches:
            for k in range(batch.num_rows):
                ids, tags, v, which = (
                    np.asarray(batch.column(c)[k].values.to_numpy(zero_copy_only=False)) for c in ("ids", "tags", "v", "queries")
                )
                for at in range(0, len(which), 1024):
                    tops.add(q.found(which[at : at + 1024], low, ids, tags, v.reshape(-1, dims)))
        if tops.parts:
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in tops.result()], names=["query", "score", "id"])

    rows = table.select("block", "ids", "tags", "v").join(wanted, "block").select("ids", "tags", "v", "queries")
    return rows.mapInArrow(compared, "query long, score long, id long")


def _batches(rows: DataFrame, workspace: Workspace) -> Iterator[pd.DataFrame]:
    """The anchors among ``rows``, BATCH at a time; rows that repeat are one anchor."""
    chosen = rows.where(F.col("vec_id") % ANCHOR_STEP == 0).distinct()
    n = chosen.count()
    parts = -(-n // BATCH)
    if parts == 1:
        yield chosen.orderBy("vec_id", "label", "v").toPandas()
        return
    dealt = workspace.keep(chosen.withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), F.lit(parts or 1))), "anchors")
    for part in range(parts):
        yield dealt.where(F.col("part") == part).drop("part").orderBy("vec_id", "label", "v").toPandas()


def _others(near: pd.DataFrame, vectors: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, id, score) of the first POSITIVES rows found for each anchor other than its own row."""
    anchor, ident, score = (near[c].to_numpy(np.int64) for c in ("query", "id", "score"))
    norms = np.array([int(v @ v) for v in vectors], np.int64)
    own = (ident == ids[anchor]) & (score == norms[anchor])
    # Of rows that repeat the anchor only the first is the anchor itself.
    first = np.zeros(len(own), bool)
    first[np.flatnonzero(own)[np.unique(anchor[own], return_index=True)[1]]] = True
    left = ~first
    anchor, ident, score = anchor[left], ident[left], score[left]
    rank = np.arange(len(anchor)) - np.searchsorted(anchor, anchor)
    return anchor[rank < POSITIVES], ident[rank < POSITIVES], score[rank < POSITIVES]


ANSWER = (
    "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
)


def mine(embeddings: DataFrame) -> DataFrame:
    """Per anchor and positive: rank from 1, negative_id and both scores.

    ``embeddings`` has vec_id, embedding and label; other columns are left out. What
    takes part is said in ``whole``; a NULL vec_id is no anchor and comes last among
    ties as a candidate, as the largest id there is. Scores are inner products in whole
    numbers, which must fit 64 bits; a shorter vector is filled up with zeros. Rows that
    repeat count each as a candidate and once as an anchor, and an anchor's copies are
    among its positives. An empty table, or one without anchors, gives an empty table.
    """
    spark: SparkSession = embeddings.sparkSession
    workspace = Workspace(spark, "negatives")
    rows = workspace.keep(whole(embeddings), "rows")
    rows = rows.withColumn("vec_id", F.coalesce("vec_id", F.lit(NO_ID)))
    table, dims = blocks(rows, workspace)
    parts = []
    for number, anchors in enumerate(_batches(rows, workspace)):
        vectors, ids = _matrix(list(anchors["v"]), dims), anchors["vec_id"].to_numpy()
        labels, own = anchors["label"].to_numpy(), np.arange(len(ids))
        free = np.full(len(ids), _WIDE)
        # One more than asked for, as the anchor finds itself.
        near = _search(table, dims, Queries(vectors, ids, labels, own, True, -free, free, POSITIVES + 1)).toPandas()
        anchor, positive, score = _others(near.sort_values(["query", "rank"]), vectors, ids)
        # 50 p <= 100 n <= 95 p, as bounds of n in whole numbers.
        low, high = -(-LEAST_SHARE * score // 100), MOST_SHARE * score // 100
        known = F.lit(NO_ID)
        hard = _search(table, dims, Queries(vectors, ids, labels, anchor, False, low, high, NEGATIVES))
        pairs = spark.createDataFrame(
            pd.DataFrame({"query": np.arange(len(anchor)), "anchor_id": ids[anchor], "positive_id": positive, "positive_score": score}),
            "query long, anchor_id long, positive_id long, positive_score long",
        )
        found = hard.join(pairs, "query").select(
            "anchor_id", F.nullif("positive_id", known).alias("positive_id"), F.col("rank").cast("int").alias("rank"),
            F.nullif("id", known).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        )
        parts.append(workspace.keep(found, f"found-{number}"))
    if not parts:
        return spark.createDataFrame([], ANSWER)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionAll(part)
    return out
